"""Language of a text by n-gram filters that answer for all languages at once.

Learning counts the letter n-grams of every training text by language. A language keeps the n-grams
that make up at least ``min_share`` of all of its own, so it keeps 1/min_share at most, whatever the
corpus size. One Bloom filter holds them all: a slot is a bit mask with a bit per language, and the AND of an
n-gram's slots is the set of languages that contain it. For a text the bits are counted per
language; a language whose filter is fuller finds more by chance, so from ``n`` n-grams
with ``hits`` hits and false positive rate f, (hits - n f) / (1 - f) are taken as real. The language
with most real hits wins; ties go to the language with more training text, then by name.

Defined cases: null, empty and letterless texts are 'und' with score 0, and so is everything where
nothing was learned. Rows without a language or without text teach nothing. Repeated rows teach and
are judged each. Masks take as many words of 64 languages as are needed. Long texts are
read whole, in slices. Extra columns pass through; ``lang_pred`` and ``score`` of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tallybook.llm.bytes import joined, scramble, slices
from tallybook.llm.common import packed

SIZES = (3, 4)
MIN_SHARE = 1e-5
SLOTS_LOG2 = 21
SLOTS_A_GRAM = 16
HASHES = 3
UNKNOWN = "und"
SPACE = 32
WORD_BITS = 64


def letters_only(text: bytes) -> bytes:
    """Lower case, all but letters as single spaces, one space at either end."""
    lowered = text.decode().lower().encode()
    raw = np.frombuffer(b" " + lowered + b" ", dtype=np.uint8)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[0] = True
    return np.where(letter, raw, np.uint8(SPACE))[kept].tobytes()


def ngrams(raw: np.ndarray, size: int) -> np.ndarray:
    """The n-gram that starts at each byte, packed in a number that also tells its size."""
    if len(raw) < size:
        return np.empty(0, dtype=np.int64)
    out = np.full(len(raw) - size + 1, size, dtype=np.int64)
    for k in range(size):
        out = (out << 8) | raw[k : len(raw) - size + 1 + k]
    return out


def gram_counts(docs: DataFrame, label: str) -> DataFrame:
    """How often each n-gram occurs in the texts of each language: lang, gram, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), dtype=object)
            order = np.argsort(names.astype(str), kind="stable")
            batch = batch.take(pa.array(order))
            for lang in dict.fromkeys(batch.column(1).to_pylist()):
                mine = pc.equal(batch.column(1), lang)
                for _, held in slices(batch.column(0).filter(mine)):
                    raw = np.frombuffer(b"".join(map(letters_only, held)), dtype=np.uint8)
                    grams = np.concatenate([ngrams(raw, size) for size in SIZES])
                    values, times = np.unique(grams, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(values)), pa.array(values), pa.array(times)],
                        ["lang", "gram", "n"],
                    )

    rows = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull())
    return (
        rows.select("text", F.col(label).alias("lang"))
        .mapInArrow(count, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )


@dataclass
class LanguageFilter:
    """The bit-sliced filter: ``masks`` by slot, false positive rates by language.

    ``masks`` has an array for every 64 languages, so a slot is as many words as they need.
    """

    languages: list[str]
    masks: list[np.ndarray]
    rates: np.ndarray

    @staticmethod
    def word(languages: int) -> type:
        """The narrowest word with a bit for each."""
        kinds = (np.uint8, np.uint16, np.uint32, np.uint64)
        return next(k for k in kinds if languages <= 8 * np.dtype(k).itemsize)

    @staticmethod
    def places(grams: np.ndarray, slots: int) -> Iterator[np.ndarray]:
        h = scramble(grams)
        step = (h >> np.uint64(32)) | np.uint64(1)
        for k in range(HASHES):
            yield ((h + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64)

    @classmethod
    def build(cls, languages: list[str], grams: list[np.ndarray], slots: int) -> LanguageFilter:
        sizes = [min(WORD_BITS, len(languages) - n) for n in range(0, len(languages), WORD_BITS)]
        masks = [np.zeros(slots, dtype=cls.word(size)) for size in sizes]
        rates = np.zeros(len(languages))
        for n, own in enumerate(grams):
            mine = np.zeros(slots, dtype=bool)
            for place in cls.places(own, slots):
                mine[place] = True
            words = masks[n // WORD_BITS]
            words[mine] |= words.dtype.type(1 << n % WORD_BITS)
            rates[n] = mine.mean() ** HASHES
        return cls(languages, masks, rates)

    def contained(self, grams: np.ndarray) -> list[np.ndarray]:
        """Bit masks of the languages that contain each n-gram, an array for every 64 languages."""
        slots = len(self.masks[0])
        found: list[np.ndarray] = []
        for place in self.places(grams, slots):
            here = [words[place] for words in self.masks]
            found = [a & b for a, b in zip(found, here, strict=True)] if found else here
        return found

    def hits(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of each text, and how many of them each language's filter contains."""
        raw, starts = joined(parts)
        total = np.zeros(len(parts))
        hits = np.zeros((len(parts), len(self.languages)))
        for size in SIZES:
            grams = ngrams(raw, size)
            whole = np.maximum(np.diff(starts) - size + 1, 0)
            total += whole
            found = self.contained(grams)
            for n in range(len(self.languages)):
                words = found[n // WORD_BITS]
                bit = (words >> words.dtype.type(n % WORD_BITS)) & words.dtype.type(1)
                summed = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
                first = np.minimum(starts[:-1], len(grams))
                hits[:, n] += summed[np.minimum(first + whole, len(grams))] - summed[first]
        return total, hits

    def judge(self, parts: list[bytes]) -> tuple[list[str], np.ndarray]:
        texts = [letters_only(p) for p in parts]
        total, hits = self.hits(texts)
        real = (hits - total[:, None] * self.rates) / (1 - np.minimum(self.rates, 0.999))
        best = real.argmax(axis=1)
        score = np.clip(real[np.arange(len(parts)), best] / np.maximum(total, 1), 0, 1)
        return [self.languages[b] for b in best], score


def learn(
    docs: DataFrame, label: str = "lang", min_share: float = MIN_SHARE, slots_log2: int = SLOTS_LOG2
) -> LanguageFilter:
    """The filter over all given rows. Only n-grams over the share reach the driver.

    There are at least ``2 ** slots_log2`` slots, and more where a smaller share keeps more n-grams.
    """
    counts = gram_counts(docs, label)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    kept = (
        counts.join(totals, "lang")
        .where(F.col("n") >= F.col("all") * min_share)
        .select("lang", "gram", "all")
        .toArrow()
    )
    frame = kept.to_pandas()
    sizes = frame.groupby("lang")["all"].first()
    languages = sorted(sizes.index, key=lambda name: (-sizes[name], name))
    by_name = dict(tuple(frame.groupby("lang")["gram"]))
    grams = [np.sort(by_name[name].to_numpy(dtype=np.int64)) for name in languages]
    most = max(map(len, grams), default=0) * SLOTS_A_GRAM
    slots = 1 << max(slots_log2, (most - 1).bit_length() if most else 0)
    return LanguageFilter.build(languages, grams, slots)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: LanguageFilter, keep: list[str] | None = None) -> DataFrame:
    """lang_pred and score beside the kept columns."""
    keep = list(docs.columns) if keep is None else keep
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = shared.value
        for batch in batches:
            names, scores = [], []
            for _, held in slices(pc.struct_field(batch.column("_row"), "text")):
                if filter_.languages:
                    found, sure = filter_.judge(held)
                else:
                    found, sure = [UNKNOWN] * len(held), np.zeros(len(held))
                names += found
                scores.append(sure)
            scores = np.concatenate(scores) if scores else np.empty(0)
            letters = batch.column("_letters").to_numpy(zero_copy_only=False)
            names = [n if ok else UNKNOWN for n, ok in zip(names, letters, strict=True)]
            columns = [pa.array(names, pa.string()), pa.array(np.where(letters, scores, 0.0))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), *columns], ["_row", "lang_pred", "score"]
            )

    rows = packed(docs.select(*dict.fromkeys([*keep, "text"])))
    rows = rows.withColumn("_letters", has_letter(F.col("_row.text")))
    schema = rows.select(
        "_row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")
    ).schema
    return rows.mapInArrow(judge, schema).select(
        *[F.col(f"_row.`{c}`") for c in keep], "lang_pred", "score"
    )
