import random
from collections import Counter

import cases
import numpy as np
import pytest

from tallybook.llm import suffixes

SIZE = 200


def brute(rows, size):
    raws = [(r[0], (r[1] or "").encode()) for r in rows]
    counts = Counter(b[i : i + size] for _, b in raws for i in range(len(b) - size + 1))
    out = []
    for doc, b in raws:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - size + 1):
            if counts[b[i : i + size]] > 1:
                gone[i : i + size] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((doc, len(b), int(gone.sum()), runs, kept))
    return sorted(out, key=str)


def found(docs, size=SIZE):
    rows = suffixes.remove_repeats(docs, size).collect()
    return sorted(
        (
            (
                r.doc_id,
                r.n_bytes,
                sum(s["end"] - s["first"] for s in r.spans),
                len(r.spans),
                bytes(r.kept),
            )
            for r in rows
        ),
        key=str,
    )


def passages(seed, n):
    """Texts that share passages of all lengths around the window size, at all offsets."""
    rng = random.Random(seed)
    base = cases.prose(rng, 400)
    out = []
    for i in range(n):
        at = rng.randrange(len(base) - 900)
        text = cases.prose(rng, rng.randint(1, 30)) + base[at : at + rng.randint(150, 600)]
        out.append((i, text + cases.prose(rng, rng.randint(1, 30)), None, None, 0))
    out.append((n, "ab" * 700, None, None, 0))
    out.append((n + 1, "z" * 1000 + cases.prose(rng, 20) + "z" * 300, None, None, 0))
    out.append((n + 2, base[:199], None, None, 0))
    out.append((n + 3, base[:200], None, None, 0))
    return out


@pytest.mark.parametrize(("group", "piece"), [(1024, 4 << 20), (1, 4 << 20), (3, 500)])
def test_shared_passages_as_by_brute_force(spark, monkeypatch, group, piece):
    monkeypatch.setattr(suffixes, "GROUP", group)
    rows = passages(group, 40)
    if piece < 1000:
        test = [(b"x" * 10 + bytes(range(256)) * 8)]
        whole = suffixes.anchors_of(test, SIZE)
        assert len(whole[0])
    assert found(cases.frame(spark, rows).repartition(3)) == brute(rows, SIZE)


def test_groups_stay_bounded_after_narrowing(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", 80)
    rng = random.Random(5)
    passage = cases.prose(rng, 70)

    def foreign():  # of few kinds where only some bytes of it are left in a tile
        return "".join(rng.choice("ab") for _ in range(100))

    rows = [(i, foreign() + passage + foreign(), None, None, 0) for i in range(90)]
    sizes, plain = [], suffixes.indexed

    def watched(some, tile):
        held = some.groupBy(*suffixes.CORE).count().agg({"count": "max"}).first()[0]
        sizes.append((tile, held or 0))
        return plain(some, tile)

    monkeypatch.setattr(suffixes, "indexed", watched)
    assert found(cases.frame(spark, rows).repartition(3)) == brute(rows, SIZE)
    assert dict(sizes)[8] > 1
    assert max(n for _, n in sizes) <= 80


def test_awkward_rows(spark):
    rows = cases.rows()
    assert found(cases.frame(spark, rows).repartition(3)) == brute(rows, SIZE)


def test_index_as_by_sorting():
    rng = random.Random(2)
    strings = [
        np.array([rng.choice([97, 98, 300]) for _ in range(rng.randint(0, 12))], dtype=np.int32)
        for _ in range(25)
    ]
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        owner, length, common = suffixes.column_wise_index(strings, folder)
    got = [tuple(strings[o][len(strings[o]) - n :]) for o, n in zip(owner, length, strict=True)]
    assert got == sorted(got)
    assert len(got) == sum(len(s) + 1 for s in strings)
    assert len(set(zip(owner.tolist(), length.tolist(), strict=True))) == len(got)
    for a, b, n in zip(got, got[1:], common[1:], strict=False):
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), None)
        assert n == (min(len(a), len(b)) if same is None else same)


def test_long_texts_go_in_pieces(spark, monkeypatch):
    rng = random.Random(8)
    shared = cases.prose(rng, 60)
    rows = [
        (1, cases.prose(rng, 900) + shared + cases.prose(rng, 900), None, None, 0),
        (2, shared, None, None, 0),
    ]
    # the piece length is read in the tasks, so the function under it is tried directly
    text = rows[0][1].encode()
    whole = suffixes.anchors_of([text], SIZE)
    cut = []
    for at in range(0, len(text) - SIZE + 1, 700):
        part, hashes, *places = suffixes.anchors_of([text[at : at + 700 + SIZE - 1]], SIZE)
        for h, p, a, b in zip(hashes, *places, strict=True):
            cut += [(h, p + at, w + at) for w in range(a, b + 1)]
    every = [
        (h, p, w) for h, p, a, b in zip(*whole[1:], strict=True) for w in range(a, b + 1)
    ]
    assert sorted(cut) == sorted(every)
    assert found(cases.frame(spark, rows)) == brute(rows, SIZE)


def test_short_windows_are_refused(spark):
    with pytest.raises(ValueError, match="too short"):
        suffixes.remove_repeats(cases.empty(spark), 100)


def test_empty_table(spark):
    assert suffixes.remove_repeats(cases.empty(spark)).collect() == []
