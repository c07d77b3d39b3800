"""Remove long byte strings that also start anywhere else, by a column-wise suffix index.

A window is ``size`` bytes of one text. Its anchor is the smallest hash among its
``GRAM``-byte grams, the leftmost of equals; equal windows have the same anchor at the same offset. So the windows
of all texts fall into groups by anchor, and a gram that occurs once in the collection clears all
windows around it without a comparison.

Neighbouring windows with one anchor are a run. Runs that occur more than once, by a 128-bit digest,
are repeated as a whole and settled there; one of each kind goes on where an anchor has several.
Only these meet their text again, and texts cross the network compressed.

The windows of a run are dealt to tiles of ``TILE`` neighbouring offsets. All windows of
a tile share a core, so a tile is a short string: up to TILE - 1 bytes, the core as one symbol, up to
TILE - 1 bytes; a window of it is TILE symbols in a row. Equal tiles are counted first: they
are repeated as a whole and go on as one tile. Tiles with the same core and different sides
form the collections that are indexed:

Column-wise construction: round r puts the r-th symbol from the right of every string before its
suffix. The new suffixes' places follow from counting symbols in the collection's Burrows-Wheeler
transform, the common prefixes with both neighbours from range minima over the old ones, and one pass merges
them in. Transform, prefixes and owners are files that a round reads and writes front to back.
Windows whose suffix shares TILE symbols with a neighbour are repeated.

A core with more than ``GROUP`` different tiles is cut again into narrower tiles with longer
cores, down to single windows, where equality of the core decides by plain grouping, without an index.
Equal tiles are one row again after each cut, so no group grows with the input. Cores are compared
by 128-bit digests.

Defined cases: null and empty text are no bytes. Texts shorter than a window keep everything. Rows
that repeat are copies of each other and lose all their windows. An empty table gives an empty
result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tallybook.llm.bytes import joined, scramble, slices
from tallybook.llm.common import staged, tasks, text_hash

WINDOW = 400
GRAM = 32  # a power of two
TILE, NARROWER = 64, 8
GROUP = 1_024
SHARD_TILES = 4_096
SHARDS_A_TASK = 4
PIECE_BYTES = 4 << 20
PLACE_BITS = 24
CORE = ["core_a", "core_b"]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes that start at each place, by doubling."""
    out = scramble(np.arange(256), 2)[raw]
    width = 1
    while width < GRAM:
        out = out[:-width] * np.uint64(0x9E3779B97F4A7C15) + out[width:]
        out ^= out >> np.uint64(32)
        width *= 2
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[: len(values) - (width - reach)], values[width - reach :])


def anchors_of(parts: list[bytes], size: int) -> tuple[np.ndarray, ...]:
    """Part, anchor hash, anchor place, first and last window of each run of windows."""
    raw, starts = joined(parts)
    grams = gram_hashes(raw) if len(raw) >= size else np.empty(0, dtype=np.uint64)
    if not len(grams):
        return tuple(np.empty(0, dtype=np.int64) for _ in range(5))
    place = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    chosen = (sliding_least((grams & ~low) | place, size - GRAM + 1) & low).astype(np.int64)
    count = np.maximum(np.diff(starts) - size + 1, 0)
    part = np.repeat(np.arange(len(parts)), count)
    window = np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count) + starts[part]
    at = chosen[window]
    edge = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (part[1:] != part[:-1])])
    edge = edge if len(at) else edge[:0]
    last = np.r_[edge[1:], len(at)] - 1 if len(at) else edge
    part, own = part[edge], starts[part[edge]]
    hashes = grams[at[edge]].view(np.int64)
    return part, hashes, at[edge] - own, window[edge] - own, window[last] - own


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, text_a, text_b, text: rows with the digest that names their text."""
    return docs.select(
        "doc_id",
        text_hash(F.col("text")).alias("text_a"),
        F.xxhash64(F.lit(12), "text").alias("text_b"),
        "text",
    )


def digest(raw: bytes, more: bytes = b"") -> tuple[int, int]:
    """Two signed numbers that stand for the bytes."""
    return struct.unpack("<qq", blake2b(raw, digest_size=16, salt=more).digest())


def anchors(docs: DataFrame, size: int) -> DataFrame:
    """text_a, text_b, anchor, at, first, last, run_a, run_b: every run of windows."""
    names = ["text_a", "text_b", "anchor", "at", "first", "last", "run_a", "run_b"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, held in slices(batch.column(2)):
                # long texts go in pieces that overlap by a window less a byte
                pieces = [
                    (start + n, at, text[at : at + PIECE_BYTES + size - 1])
                    for n, text in enumerate(held)
                    for at in range(0, max(1, len(text) - size + 1), PIECE_BYTES)
                ]
                step = len(pieces) if len(pieces) == len(held) else 1
                for at in range(0, len(pieces), step):
                    some = pieces[at : at + step]
                    part, hashes, *places = anchors_of([p[2] for p in some], size)
                    ends = zip(part.tolist(), places[1].tolist(), places[2].tolist(), strict=True)
                    runs = [digest(some[p][2][a : b + size]) for p, a, b in ends]
                    owner = pa.array(np.array([p[0] for p in some], dtype=np.int64)[part])
                    base = np.array([p[1] for p in some], dtype=np.int64)[part]
                    run_a, run_b = zip(*runs, strict=True) if runs else ((), ())
                    columns = [batch.column(0).take(owner), batch.column(1).take(owner)]
                    columns += [pa.array(hashes), *[pa.array(p + base) for p in places]]
                    columns += [pa.array(run_a, pa.int64()), pa.array(run_b, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names)

    rows = texts(docs).select("text_a", "text_b", "text")
    return rows.mapInArrow(work, ", ".join(f"{n} bigint" for n in names))


def compressed(docs: DataFrame) -> DataFrame:
    """doc_id, text_a, text_b, packed: what is moved when texts have to meet other rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor().compress
        for batch in batches:
            out = [pack((t.as_py() or "").encode()) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(out, pa.binary())],
                ["doc_id", "text_a", "text_b", "packed"],
            )

    fields = "doc_id bigint, text_a bigint, text_b bigint, packed binary"
    return texts(docs).mapInArrow(work, fields)


def unpacked(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def tiles_of(text: bytes, at: int, first: int, last: int, size: int) -> Iterator[tuple]:
    """Core digest, left, right and base of each tile of a run of windows."""
    for tile in range((at - last) // TILE, (at - first) // TILE + 1):
        base = at - tile * TILE  # the last window start a tile may have
        low, high = max(first, base - TILE + 1), min(last, base)
        core = text[base : base - TILE + 1 + size]
        a, b = digest(core, tile.to_bytes(4, "little"))
        yield a, b, text[low:base], text[base - TILE + 1 + size : high + size], base


def tiles(docs: DataFrame, runs: DataFrame, size: int) -> DataFrame:
    """text_a, text_b, core_a, core_b, left, right, base, n for the windows of ``runs``."""
    names = ["text_a", "text_b", "core_a", "core_b", "left", "right", "base", "n"]
    kinds = [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.int64()] * 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for row in range(batch.num_rows):
                name = tuple(batch.column(n)[row].as_py() for n in (0, 1))
                if name == before:  # a copy; its runs count as repeated without it
                    continue
                before, raw = name, unpacked(batch.column(2)[row].as_py())
                out = [
                    (*name, *tile, run["n"])
                    for run in batch.column(3)[row].as_py()
                    for tile in tiles_of(raw, run["at"], run["first"], run["last"], size)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    names,
                )

    wanted = runs.groupBy("text_a", "text_b").agg(
        F.collect_set(F.struct("at", "first", "last", "n")).alias("runs")
    )
    fields = ", ".join(f"`{n}` {'binary' if n in ('left', 'right') else 'bigint'}" for n in names)
    met = compressed(docs).join(wanted, ["text_a", "text_b"])
    return met.select("text_a", "text_b", "packed", "runs").mapInArrow(work, fields)


class ExternalColumns:
    """The index as files, one per column; a round reads the old and writes the new ones."""

    KINDS = {"before": np.int32, "common": np.int16, "owner": np.int32, "length": np.int16}

    def __init__(self, folder: str):
        self.folder, self.round = folder, 0

    def read(self, name: str) -> np.ndarray:
        return np.fromfile(f"{self.folder}/{name}-{self.round % 2}", dtype=self.KINDS[name])

    def write(self, **columns: np.ndarray) -> None:
        self.round += 1
        for name, values in columns.items():
            kind = self.KINDS[name]
            values.astype(kind, copy=False).tofile(f"{self.folder}/{name}-{self.round % 2}")


class RangeLeast:
    """Least value of any range of a row of numbers."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            half = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))
        width = max(map(len, self.levels))
        self.table = np.zeros((len(self.levels), width), dtype=values.dtype)
        for n, level in enumerate(self.levels):
            self.table[n, : len(level)] = level

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        return np.minimum(self.table[level, first], self.table[level, last + 1 - (1 << level)])


def column_wise_index(strings: list[np.ndarray], folder: str) -> tuple[np.ndarray, ...]:
    """Owner, suffix length and common prefix with the one before, of all suffixes in order."""
    count = len(strings)
    lengths = np.array([len(s) for s in strings])
    rounds = int(lengths.max(initial=0))
    symbols = np.full((count, rounds), -1, dtype=np.int32)
    for n, s in enumerate(strings):
        symbols[n, : len(s)] = s[::-1]
    files = ExternalColumns(folder)
    # the empty suffixes; nothing stands before them yet
    files.write(
        before=np.full(count, -1),
        common=np.zeros(count),
        owner=np.arange(count),
        length=np.zeros(count),
    )
    place = np.arange(count)  # of each string's longest suffix so far
    for r in range(rounds):
        live = np.flatnonzero(lengths > r)
        before, common = files.read("before"), files.read("common")
        total = len(before)
        known = np.flatnonzero(before >= 0)
        old = np.sort(before[known].astype(np.int64) * total + known)
        new = symbols[live, r].astype(np.int64) * total + place[live]
        order = np.argsort(new, kind="stable")
        live, new = live[order], new[order]
        before[place[live]] = symbols[live, r]
        # where the new suffixes go among the old ones, and then among all
        into = np.searchsorted(old, new)
        every = np.insert(old, into, new)
        mine = into + np.arange(len(new))
        least = RangeLeast(common)
        prefix = np.zeros(len(new), dtype=np.int16)
        for side in (-1, 1):
            other = mine + side
            there = (other >= 0) & (other < len(every))
            other = np.where(there, other, mine)
            alike = there & (every[other] // total == new // total)
            low = np.minimum(every[other], new) % total + 1
            high = np.maximum(every[other], new) % total
            found = np.zeros(len(new), dtype=np.int16)
            found[alike] = least(low[alike], high[alike]) + 1
            if side < 0:
                prefix = found
            else:
                after = found
        at = into + count  # the empty suffixes come first
        grown = np.insert(common, at, prefix)
        spot = at + np.arange(len(new))
        follows = spot + 1 < len(grown)
        grown[spot[follows] + 1] = after[follows]
        grown[spot] = prefix
        files_owner, files_length = files.read("owner"), files.read("length")
        files.write(
            before=np.insert(before, at, -1),
            common=grown,
            owner=np.insert(files_owner, at, live),
            length=np.insert(files_length, at, r + 1),
        )
        place[live] = spot
    return files.read("owner"), files.read("length"), files.read("common")


def repeated_windows(
    core: np.ndarray, left: list[bytes], right: list[bytes], tile: int
) -> list[np.ndarray]:
    """For each string of the collection, the windows (bytes left of the core) it shares."""
    strings = [
        np.concatenate(
            [np.frombuffer(a, np.uint8).astype(np.int32), [256 + c], np.frombuffer(b, np.uint8)]
        ).astype(np.int32)
        for c, a, b in zip(core.tolist(), left, right, strict=True)
    ]
    with tempfile.TemporaryDirectory() as folder:
        owner, length, common = column_wise_index(strings, folder)
    shared = np.maximum(common, np.r_[common[1:], 0]) >= tile
    owner, length = owner[shared], length[shared]
    window = length - np.array([len(b) for b in right], dtype=np.int64)[owner] - 1
    ok = window >= 0
    owner, window = owner[ok], window[ok]
    order = np.lexsort([window, owner])
    cut = np.searchsorted(owner[order], np.arange(1, len(strings)))
    return np.split(window[order], cut)


def runs_of(numbers: np.ndarray) -> list[tuple[int, int]]:
    if not len(numbers):
        return []
    edge = np.flatnonzero(np.diff(numbers) > 1)
    return list(
        zip(numbers[np.r_[0, edge + 1]].tolist(), numbers[np.r_[edge, -1]].tolist(), strict=True)
    )


def indexed(rows: DataFrame, tile: int) -> DataFrame:
    """seg_a, seg_b, low, high: windows that different tiles of one core share."""
    fields = "seg_a bigint, seg_b bigint, low bigint, high bigint"
    spark = rows.sparkSession
    shards = max(SHARDS_A_TASK * tasks(spark), rows.count() // SHARD_TILES)

    def work(table: pa.Table) -> pa.Table:
        a, b = (table.column(c).to_numpy() for c in CORE)
        _, core = np.unique(np.stack([a, b], axis=1), axis=0, return_inverse=True)
        left, right = (table.column(c).to_pylist() for c in ("left", "right"))
        found = repeated_windows(core.ravel(), left, right, tile)
        alone = table.column("n").to_numpy() == 1
        ids = [table.column(c).to_numpy() for c in ("seg_a", "seg_b", "shift")]
        out = [
            (ids[0][n], ids[1][n], low + ids[2][n], high + ids[2][n])
            for n in np.flatnonzero(alone)
            for low, high in runs_of(found[n])
        ]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        names = ["seg_a", "seg_b", "low", "high"]
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(names, columns, strict=True)})

    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64(*CORE), F.lit(shards)))
    # the rows are small and the work on them is not: the number of tasks is given, so none are merged
    return dealt.repartition(tasks(spark), "_shard").groupBy("_shard").applyInArrow(work, fields)


def narrower(rows: DataFrame, tile: int, new: int) -> DataFrame:
    """The same windows in tiles of ``new`` offsets, with what their windows share in the core."""

    def last(value: Column, count: Column) -> Column:
        have = F.octet_length(value)
        keep = F.least(have, F.greatest(count, F.lit(0)))
        return F.substring(value, (have - keep + 1).cast("int"), keep.cast("int"))

    def head(value: Column, count: Column) -> Column:
        return F.substring(value, F.lit(1), F.greatest(count, F.lit(0)).cast("int"))

    part = F.col("_part")
    gone_left = part * new  # bytes of the left side that join the core
    gone_right = tile - (part + 1) * new
    lefts, rights = F.octet_length("left"), F.octet_length("right")
    inner = [last(F.col("left"), gone_left), head(F.col("right"), gone_right)]
    out_left = head(F.col("left"), lefts - gone_left)
    out_right = last(F.col("right"), rights - gone_right)
    return (
        rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(tile // new - 1))))
        # the part has a window if both sides reach its shared stretch
        .where((lefts >= gone_left) & (rights >= gone_right))
        .select(
            "seg_a",
            "seg_b",
            "n",
            (F.col("shift") + gone_left).alias("shift"),
            F.xxhash64(F.lit(1), *CORE, part, *inner).alias("core_a"),
            F.xxhash64(F.lit(2), *CORE, part, *inner).alias("core_b"),
            last(out_left, F.lit(new - 1)).alias("left"),
            head(out_right, F.lit(new - 1)).alias("right"),
        )
    )


def shared_windows(segments: DataFrame) -> DataFrame:
    """seg_a, seg_b, low, high: windows of each distinct tile that occur more than once."""
    rows, tile, found = segments.withColumn("shift", F.lit(0).cast("bigint")), TILE, []
    kind = [*CORE, "left", "right"]
    while True:
        # one row of each kind: its only segment, or one of several that are settled together
        only = F.min(F.struct("seg_a", "seg_b", "shift")).alias("only")
        alike = rows.groupBy(*kind).agg(F.sum("n").alias("all"), only)
        cores = alike.groupBy(*CORE).agg(F.count(F.lit(1)).alias("kinds"))
        alike = alike.join(cores, CORE).where((F.col("kinds") > 1) | (F.col("all") > 1))
        alike = staged(alike, "tile-kinds")
        settled = alike.where(F.col("all") > 1)
        if tile == TILE:  # segments are distinct
            settled = settled.select(*kind, "only.*")
        else:
            settled = rows.join(settled.select(*kind), kind)
        shortest = F.lit(tile - 1) - F.octet_length("right")
        found.append(
            settled.select(
                "seg_a",
                "seg_b",
                (F.col("shift") + F.greatest(shortest, F.lit(0))).alias("low"),
                (F.col("shift") + F.octet_length("left")).alias("high"),
            )
        )
        mixed = alike.where(F.col("kinds") > 1).select(
            *kind, "kinds", F.col("all").alias("n"), "only.*"
        )
        found.append(indexed(mixed.where(F.col("kinds") <= GROUP), tile))
        large = mixed.where(F.col("kinds") > GROUP)
        if tile == 1 or large.isEmpty():
            break
        rows = narrower(large, tile, tile // NARROWER)
        tile //= NARROWER
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs), kept (bytes) of every row."""
    fields = "doc_id bigint, n_bytes bigint, spans array<struct<first:bigint,end:bigint>>, kept binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, removed, kept = [], [], []
            for packed, some in zip(batch.column(1), batch.column(2), strict=True):
                raw, runs, rest, done = unpacked(packed.as_py()), [], [], 0
                for span in sorted((s["first"], s["end"]) for s in some.as_py() or ()):
                    if runs and span[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], span[1])
                    else:
                        runs.append(list(span))
                for first, end in runs:
                    rest.append(raw[done:first])
                    done = end
                rest.append(raw[done:])
                sizes.append(len(raw))
                removed.append([{"first": a, "end": b} for a, b in runs])
                kept.append(b"".join(rest))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, kind),
                    pa.array(kept, pa.binary()),
                ],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    met = compressed(docs).join(spans, ["text_a", "text_b"], "left")
    return met.select("doc_id", "packed", "spans").mapInArrow(work, fields)


def remove_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, spans, kept: each text without the windows that occur elsewhere.

    ``size`` is at least 2 * TILE + GRAM, so that a core holds its anchor.
    """
    if size < 2 * TILE + GRAM:
        raise ValueError("windows are too short for the tiles")
    found = staged(anchors(docs, size), "anchors")
    twice = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    # both sides of a join come from files, so that Spark can split the partition of a busy anchor
    twice = staged(twice.select("anchor"), "anchors-met-again")
    hits = staged(found.join(twice, "anchor"), "repeated-anchors")
    run = ["anchor", "run_a", "run_b"]
    place = F.struct("text_a", "text_b", "at", "first", "last")
    kinds = hits.groupBy(*run).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place"))
    kinds = staged(kinds, "runs")
    whole = hits.join(kinds.where(F.col("n") > 1).select(*run), run).select(
        "text_a", "text_b", "first", (F.col("last") + size).alias("end")
    )
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1)
    several = staged(several.select("anchor"), "anchors-of-many-runs")
    mixed = kinds.join(several, "anchor").select("place.*", "n")
    segment = [
        F.xxhash64(F.lit(n), *CORE, "left", "right").alias(name)
        for n, name in ((3, "seg_a"), (4, "seg_b"))
    ]
    around = staged(tiles(docs, mixed, size).select("*", *segment), "tiles")
    distinct = around.groupBy("seg_a", "seg_b", *CORE, "left", "right").agg(F.sum("n").alias("n"))
    part = around.join(shared_windows(distinct), ["seg_a", "seg_b"]).select(
        "text_a",
        "text_b",
        (F.col("base") - F.col("high")).alias("first"),
        (F.col("base") - F.col("low") + size).alias("end"),
    )
    spans = (
        whole.unionByName(part)
        .groupBy("text_a", "text_b")
        .agg(F.collect_set(F.struct("first", "end")).alias("spans"))
    )
    return cut(docs, spans)
