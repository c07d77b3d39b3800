import random

import cases
import pytest
from pyspark.sql import functions as F

from tallybook.llm import debruijn
from tallybook.llm.common import staged


def brute(rows, size):
    """doc_id, words, removed words, kept text of every row."""
    late = float("inf")
    split = [(late if r[0] is None else r[0], cases.WORD.findall(r[1] or "")) for r in rows]
    earliest = {}
    for i, words in split:
        for at in range(len(words) - size + 1):
            key = tuple(words[at : at + size])
            earliest[key] = min(earliest.get(key, late), i)
    out = []
    for (i, words), row in zip(split, rows, strict=True):
        gone = set()
        for at in range(len(words) - size + 1):
            if earliest[tuple(words[at : at + size])] < i:
                gone.update(range(at, at + size))
        kept = " ".join(w for n, w in enumerate(words) if n not in gone)
        out.append((row[0], len(words), len(gone), kept))
    return sorted(out, key=str)


def found(docs, **options):
    got = debruijn.remove_earlier(docs, **options)
    assert got.columns == ["doc_id", "n_words", "spans", "kept"]
    return sorted(
        (
            (r.doc_id, r.n_words, sum(s.end - s.first for s in r.spans), r.kept)
            for r in got.collect()
        ),
        key=str,
    )


def texts(spark, some):
    return cases.frame(spark, [(i, t, "a", "s", 0) for i, t in some]).repartition(3)


def test_documents_with_every_case(spark):
    rows = cases.rows()
    want = brute(rows, 50)
    assert sum(w[2] for w in want) > 500
    assert found(cases.documents(spark)) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_branching_words_and_rings(spark, seed):
    rng = random.Random(seed)
    some = [(n, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for n in range(40)]
    some += [(50, "a " * 80), (51, "a " * 30), (52, "ab " * 40 + "a b " * 40), (None, "a " * 20)]
    passage = " ".join(rng.choice("abcdefgh") for _ in range(90))
    some += [(60 + n, f"x{n} {passage} y{n}") for n in range(9)]
    some += [(70, passage[:100]), (71, passage[60:]), (None, passage), (None, passage), (-5, passage)]
    for n in range(30):  # near copies, each with a change of its own
        words = passage.split()
        words[rng.randrange(90)] = f"z{n}"
        some.append((100 + n, " \n".join(words)))
    rng.shuffle(some)
    rows = [(i, t) for i, t in some]
    assert found(texts(spark, some), size=8, gram=4) == brute(rows, 8)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(debruijn, "PIECE_BYTES", 500)
    rng = random.Random(4)
    long = [f"w{rng.randrange(4000)}" for _ in range(3000)]
    some = [(1, " ".join(long)), (2, " ".join([*long[:1500], "new", *long[1500:]])), (3, "x" * 2000)]
    some += [(4, " ".join(long[700:900]))]
    assert found(texts(spark, some), size=10, gram=4) == brute(some, 10)


def test_pieces_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(debruijn, "PIECE_BYTES", 100)
    text = b"  ".join(b"%d" % n for n in range(300))
    seen = []
    for at, piece in debruijn.pieces(text, 7):
        words = piece.split()
        seen += [(at + n, words[n : n + 7]) for n in range(len(words) - 6)]
    assert [s[0] for s in seen] == list(range(294))
    assert all(w == text.split()[n : n + 7] for n, w in seen)


def test_paths_are_as_long_as_they_can_be(spark):
    """One passage in five documents is one path, whatever the number of its edges."""
    rng = random.Random(6)
    passage = " ".join(f"p{rng.randrange(10_000)}" for _ in range(400))
    docs = texts(spark, [(n, f"{n} {passage} {n}{n}") for n in range(5)])
    found = staged(debruijn.super_kmers(docs, 50, 16), "super-k-mers")
    busy = found.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
    hits = staged(found.join(busy.select("anchor"), "anchor"), "shared-runs")
    places = debruijn.edge_places(hits, debruijn.shared_edges(docs, hits, 50))
    paths = debruijn.compacted(debruijn.nonbranching(places))
    assert places.select(*debruijn.EDGE).distinct().count() > 10
    assert paths.select("head_a", "head_b").distinct().count() == 1
    spans = debruijn.repeated_spans(places, 50)
    assert {(r.id, len(r.spans)) for r in spans.collect()} == {(n, 1) for n in range(1, 5)}


def test_empty(spark):
    assert debruijn.remove_earlier(cases.empty(spark)).collect() == []
    with pytest.raises(ValueError):
        debruijn.remove_earlier(cases.empty(spark), gram=12)
