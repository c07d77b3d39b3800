import random

import cases
import numpy as np
import pytest
import xxhash

from tallybook.llm import simhash
from tallybook.llm.components import components


def fingerprint(text, size=3):
    words = cases.WORD.findall(cases.lower(text or ""))
    size = min(size, len(words))
    parts = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, most):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    array = np.array(values, dtype=np.uint64)
    for a in range(len(values)):
        for b in np.flatnonzero(np.bitwise_count(array ^ array[a]) <= most).tolist():
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(values))]


def test_documents_as_by_brute_force(spark):
    rows = cases.rows()
    found = simhash.near_duplicates(cases.frame(spark, rows).repartition(3)).collect()
    marks = [fingerprint(r[1]) for r in rows]
    groups = brute_components(marks, 3)
    ids = {}
    for r, g in zip(rows, groups, strict=True):
        ids.setdefault(g, []).append(r[0])
    least = {g: min((i for i in own if i is not None), default=None) for g, own in ids.items()}
    want = [
        (r[0], format(m, "016x"), least[g]) for r, m, g in zip(rows, marks, groups, strict=True)
    ]
    got = [(r.doc_id, format(r.fp & (1 << 64) - 1, "016x"), r.component_id) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)


def clustered(rng, n):
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("most", "cell"), [(3, 2048), (3, 50), (2, 50), (0, 50), (5, 64)])
def test_links_of_crowded_fingerprints(spark, monkeypatch, most, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    values = clustered(random.Random(most), 500)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint")
    linked = components(simhash.links(frame, most)).collect()
    groups = brute_components(values, most)
    want = {}
    for v, g in zip(values, groups, strict=True):
        want.setdefault(g, set()).add(v)
    got = {}
    for r in linked:
        got.setdefault(r.component, set()).add(r.node & (1 << 64) - 1)
    assert {frozenset(x) for x in got.values()} == {
        frozenset(x) for x in want.values() if len(x) > 1
    }


def test_tree_finds_exactly_the_near_pairs():
    rng = random.Random(3)
    values = np.array(clustered(rng, 300), dtype=np.uint64)
    values = values[np.argsort(simhash.gray_rank(values))]
    groups = np.sort(np.array([rng.randrange(3) for _ in values]))
    tree = simhash.GrayTree(values, groups)
    query, node = tree.near(np.arange(len(values)), values, 3)
    want = {
        (a, b)
        for a in range(300)
        for b in range(a + 1, 300)
        if groups[a] == groups[b] and np.bitwise_count(values[a] ^ values[b]) <= 3
    }
    assert set(zip(query.tolist(), node.tolist(), strict=True)) == want


@pytest.mark.parametrize("count", [10, 1 << 27, 1 << 36])
def test_blocks_cover_every_choice(count):
    masks = simhash.block_masks(count, 3)
    rng = random.Random(1)
    for _ in range(300):
        bits = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not m & bits for m in masks)


def test_chain_of_components(spark):
    links = spark.createDataFrame([(n, n + 1) for n in range(40)] + [(90, 91), (7, 7)], "u bigint, v bigint")
    found = {r.node: r.component for r in components(links).collect()}
    assert found == {**{n: 0 for n in range(41)}, 90: 90, 91: 90}


def test_one_of_each_group_stays(spark):
    docs = cases.documents(spark)
    found = simhash.near_duplicates(docs).toPandas()
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(
        found.component_id.dropna().astype(int).unique()
    )


def test_empty_table(spark):
    assert simhash.near_duplicates(cases.empty(spark)).collect() == []
    assert simhash.keep_one_each(cases.empty(spark)).collect() == []
