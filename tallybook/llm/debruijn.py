"""Remove long word sequences that an earlier document holds, by compacting a de Bruijn graph.

A window is ``size`` consecutive words of one document; windows are the edges of the graph, and two of
them meet in the ``size`` - 1 words they share. A window that starts in a document with a smaller id is
removed from all later ones.

Super k-mers: the anchor of a window is its ``GRAM``-word gram with the smallest hash, the leftmost of equals.
Neighbouring windows with one anchor are a run, named by a digest of its words, and all equal windows have
the same anchor at the same place. So an anchor that only one document holds clears its runs without a look at
their windows, and where all runs of an anchor are alike the run is one edge, known as a whole. Only runs
of anchors with several kinds of runs are taken apart into single windows, one copy of each kind, from their text;
neighbouring windows that the same kinds hold are one edge again.

Compaction: what is left are edges that at least two documents hold, with their places. An edge and the
next one are one path if every place of either goes on with the other: in the graph, their node
branches nowhere and no document ends or begins there. Paths grow by joins that double
their length each round, until every edge knows the head of its path and its distance from it.

Coordinates: the edges found in a document are put together by head and by the place where that head would be.
They are one span if they lie there without a gap; otherwise each stands for itself. The words of all
spans whose path starts in an earlier document go.

Defined cases: null text has no words and comes back as ''. Texts with fewer words than a window keep all of
them. A row without an id counts as later than every row with one, and not as earlier than another without.
Rows with one id are never earlier than each other, so repeated rows lose the same words. Very long
texts are read in pieces that overlap by a window less a word. An empty table gives an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from tallybook.llm.bytes import scramble, slices
from tallybook.llm.common import staged, text_hash
from tallybook.llm.suffixes import sliding_least

WINDOW = 50
GRAM = 16  # a power of two
PIECE_BYTES = 4 << 20
SLICE_BYTES = 1 << 19
PLACE_BITS = 24
LAST_ID = (1 << 63) - 1
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
ODD = np.uint64(0x9E3779B97F4A7C15)
LETTERS = scramble(np.arange(256), 11)

TEXT = ["id", "text_hash"]
RUN = ["run_a", "run_b"]
EDGE = ["edge_a", "edge_b"]


class Words:
    """Words of several texts in one row of bytes, each followed by one blank."""

    def __init__(self, parts: list[bytes]):
        raw = np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)
        blank = BLANK[raw]
        after = np.empty(len(raw), dtype=bool)
        after[:1] = False
        np.logical_not(blank[:-1], out=after[1:])
        stop = blank & after
        self.raw = np.where(blank, np.uint8(32), raw)[~blank | stop]
        ends = np.cumsum([len(p) + 1 for p in parts])
        # words that end in each part
        self.counts = np.diff(np.r_[0, np.searchsorted(np.flatnonzero(stop), ends)])
        self.ends = np.flatnonzero(self.raw == 32)
        self.starts = np.r_[0, self.ends + 1][: len(self.ends)]
        self.first = np.cumsum(self.counts) - self.counts  # word of each part

    def hashes(self) -> np.ndarray:
        """One number per word."""
        if not len(self.starts):
            return np.empty(0, dtype=np.uint64)
        sizes = self.ends - self.starts + 1
        powers = np.full(int(sizes.max()), ODD, dtype=np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        place = np.arange(len(self.raw), dtype=np.int32 if len(self.raw) < 1 << 31 else np.int64)
        place -= np.repeat(self.starts, sizes).astype(place.dtype)
        return scramble(np.add.reduceat(LETTERS[self.raw] * powers[place], self.starts), 12)

    def text(self, first: int, end: int) -> bytes:
        """The words from ``first`` to before ``end``, with a blank between them."""
        return self.raw[self.starts[first] : self.ends[end - 1]].tobytes() if first < end else b""


def pieces(text: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    """A text, or where it is long parts of it that overlap by a window less a word, with their first word."""
    if len(text) <= PIECE_BYTES:
        yield 0, text
        return
    words = Words([text])
    step = max(size, len(words.starts) * PIECE_BYTES // (len(words.raw) + 1))
    for at in range(0, max(1, len(words.starts) - size + 1), step):
        yield at, words.text(at, min(at + step + size - 1, len(words.starts)))


def runs_of(words: Words, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Part, anchor hash, first and last window of each run; windows are words of all parts in a row."""
    count = np.maximum(words.counts - size + 1, 0)
    none = np.empty(0, dtype=np.int64)
    if not count.sum():
        return none, none, none, none
    grams, width = words.hashes(), 1
    while width < gram:
        grams = grams[:-width] * ODD + grams[width:]
        grams ^= grams >> np.uint64(32)
        width *= 2
    grams = scramble(grams, 13)
    low = np.uint64((1 << PLACE_BITS) - 1)
    place = np.arange(len(grams), dtype=np.uint64)
    chosen = (sliding_least((grams & ~low) | place, size - gram + 1) & low).astype(np.int64)
    part = np.repeat(np.arange(len(count)), count)
    window = np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count) + words.first[part]
    at = chosen[window]
    edge = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (part[1:] != part[:-1])])
    last = np.r_[edge[1:], len(at)] - 1
    return part[edge], grams[at[edge]].view(np.int64), window[edge], window[last]


def digest(raw: bytes) -> tuple[int, int]:
    """Two signed numbers that stand for the words."""
    return struct.unpack("<qq", blake2b(raw, digest_size=16).digest())


def named(docs: DataFrame) -> DataFrame:
    """doc_id, id, text_hash, text. Rows without an id come last."""
    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(
        doc_id.alias("doc_id"),
        F.coalesce(doc_id, F.lit(LAST_ID)).alias("id"),
        text_hash(F.col("text")).alias("text_hash"),
        "text",
    )


def super_kmers(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """id, text_hash, anchor, first (window), length (windows), run_a, run_b of every run."""
    fields = "id bigint, text_hash bigint, anchor bigint, first bigint, length int, run_a bigint, run_b bigint"
    names = [f.split()[0] for f in fields.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, held in slices(batch.column(2), SLICE_BYTES):
                cut = [(start + n, *piece) for n, t in enumerate(held) for piece in pieces(t, size)]
                step = len(cut) if len(cut) == len(held) else 1
                for at in range(0, len(cut), step):
                    some = cut[at : at + step]
                    words = Words([p[2] for p in some])
                    part, anchor, first, last = runs_of(words, size, gram)
                    ends = zip(first.tolist(), (last + size).tolist(), strict=True)
                    runs = [digest(words.text(a, b)) for a, b in ends]
                    run_a, run_b = zip(*runs, strict=True) if runs else ((), ())
                    owner = pa.array(np.array([p[0] for p in some], dtype=np.int64)[part])
                    base = np.array([p[1] for p in some], dtype=np.int64) - words.first
                    columns = [
                        batch.column(0).take(owner),
                        batch.column(1).take(owner),
                        pa.array(anchor),
                        pa.array(first + base[part]),
                        pa.array((last - first + 1).astype(np.int32)),
                        pa.array(run_a, pa.int64()),
                        pa.array(run_b, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return named(docs).select("id", "text_hash", "text").mapInArrow(work, fields)


def compressed(docs: DataFrame) -> DataFrame:
    """doc_id, id, text_hash, packed: what is moved when texts have to meet other rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor().compress
        for batch in batches:
            out = [pack((t.as_py() or "").encode()) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(out, pa.binary())], ["doc_id", *TEXT, "packed"]
            )

    return named(docs).mapInArrow(work, "doc_id bigint, id bigint, text_hash bigint, packed binary")


def unpacked(packed: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed.as_py())


def single_windows(docs: DataFrame, kinds: DataFrame, size: int) -> DataFrame:
    """run_a, run_b, shift, window_a, window_b, owner, latest: the windows of one copy of each kind of run."""
    fields = (
        "run_a bigint, run_b bigint, shift int, window_a bigint, window_b bigint, owner bigint, latest bigint"
    )
    types = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for row in range(batch.num_rows):
                name = (batch.column(0)[row].as_py(), batch.column(1)[row].as_py())
                if name == before:  # a repeated row
                    continue
                before, words = name, Words([unpacked(batch.column(2)[row])])
                out = [
                    (
                        run["run_a"], run["run_b"], n, *digest(words.text(at, at + size)),
                        run["owner"], run["latest"],
                    )
                    for run in batch.column(3)[row].as_py()
                    for n, at in enumerate(range(run["first"], run["first"] + run["length"]))
                ]
                columns = zip(zip(*out, strict=True), types, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in columns],
                    [f.split()[0] for f in fields.split(", ")],
                )

    wanted = kinds.groupBy(*TEXT).agg(
        F.collect_set(F.struct("first", "length", *RUN, "owner", "latest")).alias("runs")
    )
    # copies of a text come one after the other, so each text is read once
    met = compressed(docs).drop("doc_id").join(wanted, TEXT).sortWithinPartitions(*TEXT)
    return met.select(*TEXT, "packed", "runs").mapInArrow(work, fields)


def shared_edges(docs: DataFrame, hits: DataFrame, size: int) -> DataFrame:
    """run_a, run_b, shift, windows, edge_a, edge_b, owner: the edges several documents hold, by run.

    ``owner`` is the smallest id that holds the edge. Neighbouring windows that the same kinds of runs
    hold are one edge, named by the first of them: all these kinds have them side by side.
    """
    kinds = hits.groupBy("anchor", *RUN, "length").agg(
        F.min("id").alias("owner"),
        F.max("id").alias("latest"),
        F.min(F.struct(*TEXT, "first")).alias("place"),
    )
    kinds = staged(kinds, "kinds-of-runs")
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    several = staged(several.select("anchor"), "anchors-of-several-runs")
    whole = (
        kinds.join(several, "anchor", "left_anti")
        .where("owner < latest")
        .select(
            *RUN,
            F.lit(0).alias("shift"),
            F.col("length").alias("windows"),
            F.col("run_a").alias("edge_a"),
            F.col("run_b").alias("edge_b"),
            "owner",
        )
    )
    mixed = kinds.join(several, "anchor").select("place.*", "length", *RUN, "owner", "latest")
    apart = staged(single_windows(docs, mixed, size), "single-windows")
    window = ["window_a", "window_b"]
    owners = (
        apart.groupBy(*window)
        .agg(
            F.min("owner").alias("first_owner"),
            F.max("latest").alias("last_owner"),
            F.bit_xor(F.xxhash64(F.lit(1), *RUN)).alias("held_a"),
            F.bit_xor(F.xxhash64(F.lit(2), *RUN)).alias("held_b"),
        )
        .where("first_owner < last_owner")
        .select(*window, F.col("first_owner").alias("owner"), "held_a", "held_b")
    )
    shared = apart.drop("owner", "latest").join(staged(owners, "shared-windows"), window)
    along = Window.partitionBy(*RUN).orderBy("shift")
    before = F.lag(F.struct("shift", "held_a", "held_b")).over(along)
    here = F.struct((F.col("shift") - 1).alias("shift"), "held_a", "held_b")
    single = (
        shared.withColumn("_new", (~before.eqNullSafe(here)).cast("int"))
        .withColumn("_segment", F.sum("_new").over(along))
        .groupBy(*RUN, "_segment")
        .agg(F.min(F.struct("shift", *window, "owner")).alias("f"), F.count(F.lit(1)).alias("windows"))
        .select(
            *RUN,
            "f.shift",
            F.col("windows").cast("int").alias("windows"),
            F.col("f.window_a").alias("edge_a"),
            F.col("f.window_b").alias("edge_b"),
            "f.owner",
        )
    )
    return staged(whole.unionByName(single), "shared-edges")


def edge_places(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """id, text_hash, at, windows, edge_a, edge_b, owner: every place of every edge, once."""
    places = hits.join(edges, RUN).select(
        *TEXT, (F.col("first") + F.col("shift")).alias("at"), "windows", *EDGE, "owner"
    )
    return staged(places.dropDuplicates([*TEXT, "at"]), "edge-places")


def nonbranching(places: DataFrame) -> DataFrame:
    """edge_a, edge_b, head_a, head_b, away: edges with the only one before them, and its windows."""
    order = Window.partitionBy(*TEXT).orderBy("at")
    here = F.struct(*EDGE, "windows", F.col("at"))
    follows = places.select(*EDGE, "windows", "at", F.lag(here).over(order).alias("last"))
    steps = (
        follows.where("last.at + last.windows = at")
        .groupBy(F.col("last.edge_a").alias("head_a"), F.col("last.edge_b").alias("head_b"), *EDGE)
        .agg(F.count(F.lit(1)).alias("times"), F.max("last.windows").cast("bigint").alias("away"))
    )
    times = staged(places.groupBy(*EDGE).agg(F.count(F.lit(1)).alias("n")), "edge-counts")
    before = times.select(
        F.col("edge_a").alias("head_a"), F.col("edge_b").alias("head_b"), F.col("n").alias("m")
    )
    return (
        steps.join(times, EDGE)
        .join(before, ["head_a", "head_b"])
        .where("times = n AND times = m")
        .select(*EDGE, "head_a", "head_b", "away")
    )


def compacted(links: DataFrame) -> DataFrame:
    """edge_a, edge_b, head_a, head_b, away: every linked edge with the head of its path.

    A round points each edge to where the edge it points to points, so paths double. There are no
    rings: every place of a linked edge has a place before it in the same text, and texts begin.
    """
    known = staged(links, "paths")
    while True:
        further = known.select(
            F.col("edge_a").alias("head_a"),
            F.col("edge_b").alias("head_b"),
            F.col("head_a").alias("_a"),
            F.col("head_b").alias("_b"),
            F.col("away").alias("_away"),
        )
        met = known.join(further, ["head_a", "head_b"], "left")
        grown = F.col("_away").isNotNull()
        known = staged(
            met.select(
                *EDGE,
                F.when(grown, F.col("_a")).otherwise(F.col("head_a")).alias("head_a"),
                F.when(grown, F.col("_b")).otherwise(F.col("head_b")).alias("head_b"),
                (F.col("away") + F.coalesce("_away", F.lit(0))).alias("away"),
                grown.alias("grown"),
            ),
            "paths",
        )
        if known.where("grown").isEmpty():
            return known.drop("grown")


def repeated_spans(places: DataFrame, size: int) -> DataFrame:
    """id, text_hash, spans: words that an earlier document holds, as array<struct<first, end>>."""
    paths = compacted(nonbranching(places))
    later = places.where("owner < id").join(paths, EDGE, "left")
    head = [F.coalesce(f"head_{x}", f"edge_{x}").alias(f"head_{x}") for x in "ab"]
    start = (F.col("at") - F.coalesce("away", F.lit(0))).alias("start")
    spans = (
        later.select(*TEXT, *head, start, "at", (F.col("at") + F.col("windows")).alias("stop"))
        .groupBy(*TEXT, "head_a", "head_b", "start")
        .agg(
            F.min("at").alias("low"),
            F.max("stop").alias("high"),
            F.sum(F.col("stop") - F.col("at")).alias("windows"),
            F.collect_list(F.struct(F.col("at").alias("low"), F.col("stop").alias("high"))).alias("each"),
        )
    )
    gapless = F.col("high") - F.col("low") == F.col("windows")
    whole = F.array(F.struct("low", "high"))
    return (
        spans.select(*TEXT, F.inline(F.when(gapless, whole).otherwise(F.col("each"))))
        .groupBy(*TEXT)
        .agg(
            F.collect_list(
                F.struct(F.col("low").alias("first"), (F.col("high") + size - 1).alias("end"))
            ).alias("spans")
        )
    )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of words."""
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_words, spans (maximal runs of removed words), kept (words with a blank between)."""
    fields = "doc_id bigint, n_words bigint, spans array<struct<first:bigint,end:bigint>>, kept string"
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for packed, some in zip(batch.column(1), batch.column(2), strict=True):
                words = Words([unpacked(packed)])
                count = len(words.starts)
                gone = merged([(s["first"], s["end"]) for s in some.as_py() or ()])
                stays = zip([0, *[b for _, b in gone]], [*[a for a, _ in gone], count], strict=True)
                counts.append(count)
                removed.append([{"first": a, "end": b} for a, b in gone])
                kept.append(b" ".join(words.text(a, b) for a, b in stays if a < b))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(removed, kind),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "spans", "kept"],
            )

    met = compressed(docs).join(spans, TEXT, "left")
    return met.select("doc_id", "packed", "spans").mapInArrow(work, fields)


def remove_earlier(docs: DataFrame, size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, spans, kept: each text without the windows that start in an earlier document.

    ``gram`` is a power of two below ``size``.
    """
    if not 0 < gram < size or gram & (gram - 1):
        raise ValueError("gram has to be a power of two below the window")
    found = staged(super_kmers(docs, size, gram), "super-k-mers")
    busy = found.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    # both sides of a join come from files, so that Spark can split the partition of a busy anchor
    busy = staged(busy.where("low < high").select("anchor"), "shared-anchors")
    hits = staged(found.join(busy, "anchor"), "shared-runs")
    places = edge_places(hits, shared_edges(docs, hits, size))
    return cut(docs, repeated_spans(places, size))
