import cases
import public_tokenizers
import test_lines
import test_simhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallybook.llm import mixing
from tallybook.llm.common import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain(frame):
    return [tuple(r) for r in frame.select(*COLUMNS).collect()]


def test_stages_one_by_one_as_by_brute_force(spark, tmp_path):
    whole = [r for r in cases.rows() if r[0] is not None]
    cases.frame(spark, whole).select(*COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = plain(docs) if "doc_id" in docs.columns else None
        given, docs = docs, staged(stage(spark, docs, str(tmp_path)), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
        if name == "language_id":
            kept = sorted(r[:2] for r in before if any(c.isalpha() for c in r[1] or ""))
            assert sorted(r[:2] for r in plain(docs)) == kept
        elif name == "line_dedup":
            want = sorted(((d, t) for d, _, _, t in test_lines.brute(before, 10)), key=str)
            assert sorted((r[:2] for r in plain(docs)), key=str) == want
        elif name == "simhash_near_dedup":
            marks = [test_simhash.fingerprint(r[1]) for r in before]
            groups = test_simhash.brute_components(marks, 3)
            first = {}
            for r, g in zip(before, groups, strict=True):
                first[g] = min(first.get(g, r[0]), r[0])
            assert sorted(r[0] for r in plain(docs)) == sorted(first.values())
        elif name == "source_mix":
            taken = {r.doc_id: r.taken for r in mixing.taken_words(given).collect() if r.taken}
            got = {}
            for r in plain(docs):
                got[r[0]] = got.get(r[0], 0) + len(cases.WORD.findall(r[1]))
            assert got == taken
        else:
            exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            tokens = sum(len(exact.encode(r[1], add_special_tokens=False).ids) + 1 for r in before)
            assert sum(r.length for r in docs.collect()) == tokens
        seen[name] = docs.count()
    assert list(seen) == [n for n, _ in corpus_pipeline.STAGES]
    assert seen["simhash_near_dedup"] < seen["line_dedup"] <= seen["language_id"] < len(whole)


def test_each_group_keeps_one_document_whatever_its_ids(spark, tmp_path):
    whole = cases.rows()
    clean = [
        (None, "one lonely text that has no number of its own at all", "a", "s1", 52),
        (None, "another quite different text without any number either, longer", "a", "s1", 62),
        (5000, "first text under a number that comes again elsewhere", "a", "s2", 52),
        (5000, "second wording, nothing like it, with the same number", "b", "s2", 53),
    ]
    whole += [*clean, clean[0]]
    docs = cases.frame(spark, whole).select(*COLUMNS).repartition(3)
    kept = plain(corpus_pipeline.simhash_near_dedup(spark, docs, str(tmp_path)))
    groups = test_simhash.brute_components([test_simhash.fingerprint(r[1]) for r in whole], 3)
    ids = {}
    for r, g in zip(whole, groups, strict=True):
        ids.setdefault(g, []).append(r[0])
    want = [min((i for i in own if i is not None), default=None) for own in ids.values()]
    assert sorted((r[0] for r in kept), key=str) == sorted(want, key=str)
    group_of = {r[:2]: g for r, g in zip(whole, groups, strict=True)}
    assert sorted(group_of[r[:2]] for r in kept) == sorted(ids)
    assert set(clean) <= set(kept)


def test_other_columns_come_out_as_they_went_in(spark, tmp_path):
    """Names that the operators use themselves: the caller's values stay with their rows."""
    names = ["score", "lang_pred", "n_lines", "n_dropped", "_drop", "taken", "component", "_row", "fp"]
    rows = cases.rows()
    plain_docs = cases.frame(spark, rows).select(*COLUMNS)
    extra = [F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names]
    docs = plain_docs.select(extra[0], *COLUMNS, *extra[1:])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = staged(stage(spark, docs, str(tmp_path)), name)
        assert kept.columns == docs.columns
        for r in kept.collect():
            number = "none" if r.doc_id is None else r.doc_id
            assert [r[n] for n in names] == [f"{n}-{number}" for n in names]
        assert plain(kept) and sorted(plain(kept), key=str) == sorted(
            plain(stage(spark, docs.select(*COLUMNS), str(tmp_path))), key=str
        )


def test_stages_of_no_documents(spark, tmp_path):
    docs = cases.empty(spark).select(*COLUMNS, F.lit(1).alias("score"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns and found.collect() == []
