from collections import Counter
from hashlib import sha256

import cases
import pytest

from tallybook.llm import lines


def brute(rows, least):
    docs = [(r[0], (r[1] or "").split("\n")) for r in rows]
    key = lambda line: cases.lower(line).strip(cases.BLANKS)
    counts = Counter(k for _, ls in docs for k in {key(x) for x in ls} if k)
    out = []
    for doc, ls in docs:
        kept = [x for x in ls if counts[key(x)] < least]
        out.append((doc, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (7, 3)])
def test_every_row_as_by_brute_force(spark, batches, fanout):
    rows = cases.rows()
    found = lines.dedup_lines(cases.frame(spark, rows).repartition(3), 3, 1, batches, fanout)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()]
    assert sorted(got, key=str) == brute(rows, 3)


def test_other_columns_stay(spark):
    found = lines.dedup_lines(cases.documents(spark), 3)
    rest = [c for c in cases.CLASHING if c != "n_lines"]
    assert {tuple(r) for r in found.select(*rest).collect()} == {tuple(rest)}
    assert all(r.n_chars == len(r.text) for r in found.select("text", "n_chars").collect())


def test_count_at_the_threshold(spark):
    rows = [(i, f"own {i}\nShared", None, None, 0) for i in range(10)]
    drop = lines.dedup_lines(cases.frame(spark, rows), 10).select("text").collect()
    assert sorted(r.text for r in drop) == sorted(f"own {i}" for i in range(10))
    keep = lines.dedup_lines(cases.frame(spark, rows[:9]), 10).select("text").collect()
    assert all(r.text.endswith("\nShared") for r in keep)


def test_runs_are_levelled(spark):
    docs = cases.documents(spark)
    runs = lines.line_runs(docs, 5)
    assert sum(r.agg({"docs": "sum"}).first()[0] or 0 for r in runs) == sum(
        len({cases.lower(x).strip(cases.BLANKS) for x in (r[1] or "").split("\n")} - {""})
        for r in cases.rows()
    )


def test_empty_table(spark):
    assert lines.dedup_lines(cases.empty(spark)).collect() == []


def test_hash_of_what_is_left():
    assert sha256(b"").hexdigest().startswith("e3b0c442")
