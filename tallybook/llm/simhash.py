"""SimHash near-duplicates through a Gray-order hierarchical index.

Equal fingerprints are one from the start, so a group of copies is one row here. Two fingerprints
within ``max_bits`` agree on all but ``max_bits`` of their blocks, so each is put under every
choice of blocks that may agree, and only fingerprints with the same bits there are compared. The
number of blocks follows the number of fingerprints and keeps these groups small; a group over
``CELL`` is cut in tiles, and pairs of tiles meet in cells of bounded size.

In a task the fingerprints of each group stand in Gray order, where neighbours share most bits. A
tree over them keeps in each node the bits that all fingerprints below agree on and that its parent
does not have yet. A search adds up, from the root down, the differences to these shared bits and drops
a whole group once they pass ``max_bits``; what reaches a leaf has its exact distance. A task
returns links to the smallest member of each local group instead of pairs.

Defined cases: a null, empty or blank text has fingerprint zero and links like any other. Texts with
fewer words than a shingle are one shingle. Repeated rows share fingerprint and component. An empty
table gives an empty result. A row without doc_id joins a component but never names one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallybook.llm.common import packed, staged, tasks, text_hash
from tallybook.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
BITS = 64
CELL = 2_048
SHARD_ROWS = 131_072
FANOUT = 8
HASHES_AT_ONCE = 65_536


def fingerprint(text: bytes, size: int) -> int:
    """Majority bits over the hashes of all shingles; bytes.lower and split know ASCII only."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    size = min(size, len(words))
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(first), HASHES_AT_ONCE):
        pairs = zip(first[at : at + HASHES_AT_ONCE], last[at : at + HASHES_AT_ONCE], strict=True)
        hashes = np.array([digest(line[a:b], SEED) for a, b in pairs], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    major = np.packbits(2 * counts > len(first), bitorder="little")
    return int(major.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, _text (a hash that tells rows apart) and fp of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ((t.as_py() or "").encode() for t in batch.column(2))
            found = [fingerprint(t, shingle_words) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.int64())],
                ["doc_id", "_text", "fp"],
            )

    rows = docs.select("doc_id", text_hash(F.col("text")).alias("_text"), "text")
    return rows.mapInArrow(work, "doc_id bigint, _text bigint, fp bigint")


def block_masks(count: int, max_bits: int) -> list[int]:
    """For each choice of blocks that may agree, the mask of their bits."""
    blocks = max_bits + 1
    while blocks < 12:
        shared = BITS * (blocks - max_bits) // blocks
        if count >> shared < CELL:
            break
        blocks += 1
    edges = [BITS * n // blocks for n in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, blocks - max_bits)]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def cells(distinct: DataFrame, masks: list[int]) -> DataFrame:
    """_cell, fp: every fingerprint in each cell it may find a link in."""
    choices = F.array(
        *[
            F.struct(
                F.lit(n).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")
            )
            for n, m in enumerate(masks)
        ]
    )
    keyed = distinct.select("fp", F.inline(choices))
    sizes = (
        keyed.groupBy("choice", "bits")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)  # alone, a fingerprint has nothing to meet
        .select("choice", "bits", F.ceil(F.col("n") / CELL).alias("tiles"))
    )
    own = F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("tiles"))
    others = F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)
    return (
        keyed.join(sizes, ["choice", "bits"])
        .withColumn("_own", own)
        .withColumn("_other", F.explode(others))
        .select(
            F.xxhash64(
                "choice", "bits", F.least("_own", "_other"), F.greatest("_own", "_other")
            ).alias("_cell"),
            "fp",
        )
    )


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each code word in the order of the reflected Gray code."""
    out = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayTree:
    """A forest with a root per group; ``groups`` are numbers in rising order."""

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        count = len(values)
        value, mask, group = values, np.full(count, np.uint64(2**64 - 1)), groups
        last = np.arange(count)
        self.levels = []
        while True:
            begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            self.levels.append((value, mask, last))
            if len(begins) == len(group):
                break
            place = np.arange(len(group)) - np.repeat(begins, np.diff(np.r_[begins, len(group)]))
            first = np.flatnonzero(place % FANOUT == 0)
            sizes = np.diff(np.r_[first, len(group)])
            differ = np.bitwise_or.reduceat(value ^ np.repeat(value[first], sizes), first)
            shared = np.bitwise_and.reduceat(mask, first) & ~differ
            self.levels[-1] += (first, sizes, mask & ~np.repeat(shared, sizes))
            value, mask, group = value[first], shared, group[first]
            last = np.r_[first[1:], len(last)] - 1 if len(self.levels) == 1 else last[
                np.r_[first[1:], len(last)] - 1
            ]
        self.root = np.searchsorted(group, groups)

    def near(self, queries: np.ndarray, values: np.ndarray, most: int) -> tuple:
        """Pairs (query, leaf) with leaf > query at most ``most`` bits apart."""
        value, mask, last = self.levels[-1][:3]
        node = self.root[queries]
        apart = np.bitwise_count((values[queries] ^ value[node]) & mask[node]).astype(np.int64)
        keep = (apart <= most) & (last[node] > queries)
        query, node, apart = queries[keep], node[keep], apart[keep]
        for value, _, last, first, sizes, extra in reversed(self.levels[:-1]):
            size = sizes[node]
            query, apart = np.repeat(query, size), np.repeat(apart, size)
            offset = np.arange(len(query)) - np.repeat(np.cumsum(size) - size, size)
            node = np.repeat(first[node], size) + offset
            apart = apart + np.bitwise_count((values[query] ^ value[node]) & extra[node])
            keep = (apart <= most) & (last[node] > query)
            query, node, apart = query[keep], node[keep], apart[keep]
        if len(self.levels) == 1:  # every group has one member
            return query[:0], node[:0]
        return query, node


def smallest_linked(count: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``count`` items, the first item it is linked to, directly or through others."""
    root = np.arange(count)
    a = np.concatenate([p[0] for p in pairs] or [root[:0]])
    b = np.concatenate([p[1] for p in pairs] or [root[:0]])
    while len(a):
        ra, rb = root[a], root[b]
        moved = ra != rb
        if not moved.any():
            break
        a, b, ra, rb = a[moved], b[moved], ra[moved], rb[moved]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    return root


def local_links(cell: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links of the fingerprints of each cell."""
    order = np.lexsort([gray_rank(fp), cell])
    cell, fp = cell[order], fp[order]
    groups = np.cumsum(np.r_[0, cell[1:] != cell[:-1]]) if len(cell) else cell
    tree = GrayTree(fp, groups)
    pairs = [
        tree.near(np.arange(at, min(at + CELL, len(fp))), fp, most)
        for at in range(0, len(fp), CELL)
    ]
    root = smallest_linked(len(fp), pairs)
    linked = np.flatnonzero(root != np.arange(len(fp)))
    return fp[linked], fp[root[linked]]


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """u, v: enough links between distinct fingerprints to connect all within ``max_bits``."""
    spark = distinct.sparkSession
    count = distinct.count()
    masks = block_masks(count, max_bits)
    shards = max(tasks(spark), count * len(masks) // SHARD_ROWS)

    def search(table: pa.Table) -> pa.Table:
        cell = table.column("_cell").to_numpy()
        fp = table.column("fp").to_numpy().view(np.uint64)
        u, v = local_links(cell, fp, max_bits)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    dealt = cells(distinct, masks).withColumn("_shard", F.pmod("_cell", F.lit(shards)))
    return dealt.groupBy("_shard").applyInArrow(search, "u bigint, v bigint")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """doc_id, _text, fp, component (its smallest fingerprint) and component_id, the smallest doc_id of
    the component, of every row."""
    marked = staged(fingerprints(docs, shingle_words), "fingerprints")
    distinct = staged(
        marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct-fingerprints"
    )
    linked = components(links(distinct.select("fp"), max_bits), "fingerprint-links")
    named = distinct.join(linked, distinct["fp"] == linked["node"], "left").select(
        "fp", "first_doc", F.coalesce("component", "fp").alias("component")
    )
    named = staged(named, "named-fingerprints")
    smallest = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    by_fp = named.join(smallest, "component").select("fp", "component", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "_text", "fp", "component", "component_id")


def one_of_each(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row of each component: that of its smallest doc_id, or one without where none has an id.
    Of rows that share this id it is the one with the smallest text hash."""
    found = near_duplicates(docs, shingle_words, max_bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text"))
    chosen = (
        found.groupBy("component")
        .agg(first.alias("first"))
        .select(F.col("first.doc_id").alias("_doc"), F.col("first._text").alias("_kept"))
    )
    rows = packed(docs).withColumns(
        {"_id": F.col("_row.doc_id"), "_hash": text_hash(F.col("_row.text"))}
    )
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_kept"))
    return rows.join(chosen, same).dropDuplicates(["_id", "_hash"]).select("_row.*")


def keep_one_each(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """The same for callers that name documents by id: without the components that have none."""
    return one_of_each(docs, shingle_words, max_bits).where(F.col("doc_id").isNotNull())
