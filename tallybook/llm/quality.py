"""Quality of a text by the vote of its nearest labelled texts.

Texts become counts of hashed letter and shape n-grams, weighted by rarity, and are projected on the
leading singular directions of a sample of labelled texts (latent-semantic vectors). The sample is
the first ``max_labelled`` labelled rows in hash order of their id; that number bounds the
fit on the driver and the vectors that are broadcast. Every text is then compared with every
labelled vector by exact cosine products, a block of texts at a time, and the labels of the
``neighbours`` nearest are averaged with their similarity as weight.

Defined cases: a null or empty text has no direction and gets the mean label of the sample. A label
that is null teaches nothing; of repeated labels of one id the smallest counts. With no labelled row
every score is 0.5. Repeated rows are scored each, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallybook.llm.bytes import joined, scramble, slices
from tallybook.llm.common import staged

MAX_LABELLED = 8192
NEIGHBOURS = 15
DIRECTIONS = 64
LETTER_BINS, SHAPE_BINS = 768, 254
BINS = LETTER_BINS + SHAPE_BINS + 2
BLOCK = 256
SHARPNESS = 8


def shapes() -> np.ndarray:
    """A class for each byte: capitals, small letters, digits and other letters are alike."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91], out[97:123], out[48:58], out[128:] = 65, 97, 48, 97
    return out


SHAPE = shapes()


def term_counts(parts: list[bytes]) -> np.ndarray:
    """Counts of hashed 3-byte and 4-shape terms, repeated words and words, a row per text."""
    raw, starts = joined(parts)
    rows = len(parts)
    owner = np.repeat(np.arange(rows), np.diff(starts))
    out = np.zeros(rows * BINS)

    def add(codes: np.ndarray, size: int, first: int, bins: int) -> None:
        inside = owner[: len(codes)] == owner[size - 1 :]
        place = (scramble(codes, size) % np.uint64(bins)).astype(np.int64) + first
        out[:] += np.bincount((owner[: len(codes)] * BINS + place)[inside], minlength=len(out))

    wide = raw.astype(np.uint32)
    if len(raw) >= 3:
        add((wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:], 3, 0, LETTER_BINS)
    if len(raw) >= 4:
        form = SHAPE[raw].astype(np.uint32)
        codes = (form[:-3] << 24) | (form[1:-2] << 16) | (form[2:-1] << 8) | form[3:]
        add(codes, 4, LETTER_BINS, SHAPE_BINS)
    out = out.reshape(rows, BINS)
    for n, part in enumerate(parts):
        words = part.split()
        out[n, -2] = sum(a == b for a, b in zip(words, words[1:], strict=False))
        out[n, -1] = len(words) - len(set(words))
    return out


@dataclass
class Voters:
    """The fitted space and the labelled vectors in it."""

    weights: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return unit((weigh(counts) * self.weights) @ self.directions)

    def scores(self, parts: list[bytes]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(parts), 0.5)
        mean = self.labels.mean()
        out = np.empty(len(parts))
        vectors = self.embed(term_counts(parts))
        k = min(self.neighbours, len(self.labels))
        for at in range(0, len(parts), BLOCK):
            block = vectors[at : at + BLOCK]
            cosine = block @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** SHARPNESS
            total = weight.sum(axis=1)
            voted = (weight * self.labels[near]).sum(axis=1)
            none = total <= 1e-12
            out[at : at + BLOCK] = np.where(none, mean, voted / np.where(none, 1, total))
        return np.clip(out, 0, 1)


def weigh(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares: a long text is not farther away than a short one."""
    total = counts[:, :LETTER_BINS].sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1)).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def sample_counts(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """Term counts of the labelled sample: label, counts."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).cast("double").alias("label"))
        .orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id")
        .limit(most)
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held in slices(batch.column(1)):
                rows = pa.array(list(term_counts(held).astype(np.float32)), pa.list_(pa.float32()))
                mine = batch.column(0).slice(first, len(held))
                yield pa.RecordBatch.from_arrays([mine, rows], ["label", "counts"])

    # one row of each id, so that no id has more than one vote and the sample keeps its bound
    one_each = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    )
    return one_each.select("label", "text").mapInArrow(count, "label double, counts array<float>")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    max_labelled: int = MAX_LABELLED,
    neighbours: int = NEIGHBOURS,
    directions: int = DIRECTIONS,
) -> Voters:
    rows = staged(sample_counts(docs, labels, label, max_labelled), "labelled").toArrow()
    marks = rows.column("label").to_numpy()
    counts = rows.column("counts").combine_chunks()
    counts = counts.flatten().to_numpy().reshape(-1, BINS) if len(counts) else np.empty((0, BINS))
    order = np.lexsort([*counts.T[:4], marks])
    marks, counts = marks[order], counts[order]
    seen = (counts > 0).sum(axis=0)
    weights = (np.log((1 + len(counts)) / (1 + seen)) + 1).astype(np.float32)
    scaled = weigh(counts) * weights
    _, vectors = np.linalg.eigh(scaled.T.astype(np.float64) @ scaled)
    basis = vectors[:, ::-1][:, :directions].astype(np.float32)
    return Voters(weights, basis, unit(scaled @ basis), marks, neighbours)


def predict(docs: DataFrame, model: Voters) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.scores(held) for _, held in slices(batch.column(1))]
            scores = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(vote, "doc_id bigint, score double")
