from collections import defaultdict

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook.llm import mixing


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + (
        [None] if None in sizes else []
    )
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / whole for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    return out


def test_targets_and_exact_quotas(spark):
    rows = cases.rows()
    docs = cases.frame(spark, rows).repartition(3)
    found = mixing.taken_words(docs).collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(cases.WORD.findall(r[1] or ""))
    want = targets(sizes)
    assert sorted((r.doc_id, r.size) for r in found if r.doc_id is not None) == sorted(
        (r[0], len(cases.WORD.findall(r[1] or ""))) for r in rows if r[0] is not None
    )
    assert all(0 <= r.taken <= 2 * r.size for r in found)
    by_size = defaultdict(lambda: [0, 0.0, 0])
    for s, t in want.items():
        by_size[sizes[s]][1] += t
    for r in found:
        by_size[r.source_size][0] += r.taken
        assert any(
            r.source_size == sizes[s] and r.target == pytest.approx(t) for s, t in want.items()
        )
    for taken, target, _ in by_size.values():
        assert abs(taken - target) <= 2


def test_reruns_agree(spark):
    rows = cases.rows(2)
    first = mixing.taken_words(cases.frame(spark, rows).repartition(2)).collect()
    again = mixing.taken_words(cases.frame(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_shards_share_no_words(spark):
    rows, slices = mixing.mix(cases.documents(spark), shards_log2=2)
    seen = set()
    found = slices.collect()
    for r in found:
        for w in range(r.first_word, r.first_word + r.words):
            at = (r.doc_id, r._text, r.source, r._copy, r.epoch, w)
            assert at not in seen
            seen.add(at)
    shuffled = mixing.shuffled(slices, 2).select("shard", F.spark_partition_id().alias("p"))
    assert all(len({r.p for r in shuffled.collect() if r.shard == s}) <= 1 for s in range(4))
    blocks = defaultdict(int)
    for r in found:
        blocks[r.shard] += r.words
    assert max(blocks.values()) - min(blocks.values()) < 0.3 * max(blocks.values())


def test_draw_follows_the_distribution(spark):
    got = (
        spark.range(4000)
        .select(
            mixing.hypergeometric(
                F.lit(60).cast("bigint"),
                F.lit(20).cast("bigint"),
                F.lit(30).cast("bigint"),
                (F.col("id") + 0.5) / 4000,
            ).alias("x")
        )
        .toPandas()["x"]
    )
    assert got.mean() == pytest.approx(10, abs=0.02)
    assert got.var() == pytest.approx(30 * (1 / 3) * (2 / 3) * 30 / 59, rel=0.02)
    assert got.between(0, 20).all()


def test_mixed_texts_are_what_was_taken(spark):
    docs = cases.documents(spark)
    taken = defaultdict(int)
    for r in mixing.taken_words(docs).collect():
        taken[r.doc_id] += r.taken
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = defaultdict(int)
    texts = {r[0]: r[1] for r in cases.rows()}
    for r in mixed.collect():
        words = cases.WORD.findall(r.text)
        got[r.doc_id] += len(words)
        assert r["_text"] == "_text" and r.n_chars == len(r.text)
        if r.doc_id is not None and len(words) == len(cases.WORD.findall(texts[r.doc_id])):
            assert r.text == texts[r.doc_id]
    assert got == {k: v for k, v in taken.items() if v}


def test_written_shards_hold_what_the_tree_gave_them(spark, tmp_path):
    """Words of a shard, of a document, and the shards a document is said to be in, all from the files."""
    docs = cases.documents(spark)
    report = mixing.write_shards(docs, f"{tmp_path}/mix", shards_log2=2).collect()
    _, slices = mixing.mix(docs, shards_log2=2)
    given = {r["shard"]: r["w"] for r in slices.groupBy("shard").agg(F.sum("words").alias("w")).collect()}
    assert {r["shard"]: r["words"] for r in report} == given
    written = spark.read.parquet(f"{tmp_path}/mix").select("shard", "words", "document.doc_id", "document.text")
    words, shards, order = defaultdict(int), defaultdict(set), []
    for r in written.collect():
        assert len(cases.WORD.findall(r["text"])) == r["words"]
        words[r["doc_id"]] += r["words"]
        shards[r["doc_id"]].add(r["shard"])
        order.append((r["shard"], r["doc_id"]))
    wanted, said = defaultdict(int), defaultdict(set)
    for r in mixing.taken_words(docs, shards_log2=2).collect():
        assert bool(r["shards"]) == (r["taken"] > 0)
        wanted[r["doc_id"]] += r["taken"]
        said[r["doc_id"]] |= set(r["shards"])
    assert dict(words) == {k: v for k, v in wanted.items() if v}
    assert shards == {k: v for k, v in said.items() if v}
    first = [d for s, d in order if s == order[0][0] and d is not None]
    assert first != sorted(first)
    assert mixing.write_shards(cases.empty(spark), f"{tmp_path}/none").collect() == []


def test_one_source_and_empty(spark):
    rows = [(i, "a b c d", None, "s", 7) for i in range(100)]
    found = mixing.taken_words(cases.frame(spark, rows)).toPandas()
    assert found.taken.sum() == 600 and np.all(found.taken <= 8)
    blank = mixing.taken_words(cases.frame(spark, [(1, "", None, None, 0)])).first()
    assert (blank.size, blank.target, blank.taken) == (0, 0.0, 0)
    assert mixing.taken_words(cases.empty(spark)).collect() == []
    assert mixing.mixed_documents(cases.empty(spark)).collect() == []
