"""Token sequences packed by the sum-of-squares rule.

Tokenizing and cutting run per document. Pieces are dealt by hash to groups of about
``group_pieces``; each group is packed on its own, longest piece first: a piece goes where the
sum over gaps of the squared number of open sequences with that gap becomes smallest, ties
to the smaller gap; a new sequence is opened where the piece fits in no open one. A group keeps its pieces' lengths and one stack of open
sequences per gap in memory, so memory follows the group size and not the input. A group
leaves a few sequences open at its end, against thousands that it fills.

Defined cases: null text is empty and gives the single end id. Repeated rows are packed each.
An empty table gives no pieces. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallybook.llm.common import staged, tasks

CAPACITY = 2048
END_ID = 0
GROUP_PIECES = 65_536
FIRST_OTHER_BYTE = 0xCA  # UTF-8 lead byte of U+0280, beyond Latin letters

# Fixed value: how the public byte-level vocabulary splits text before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(path: str) -> dict[bytes, int]:
    """Ids by bytes from a byte-level tokenizer file, which spells every byte as a letter."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
    with open(path, encoding="utf-8") as file:
        words = json.load(file)["model"]["vocab"]
    return {
        bytes(map(byte_of.__getitem__, word)): number
        for word, number in words.items()
        if all(letter in byte_of for letter in word)
    }


class Encoder:
    """Ids of a text as little-endian 32-bit bytes.

    Latin texts take the quicker of the two installed byte-pair encoders, given the same
    vocabulary. Texts with other letters or with a special token go to the tokenizer itself, so
    that no difference between the two libraries' letter tables can matter.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: n for n, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        ranks = {w: n for w, n in vocabulary(path).items() if n not in added.values()}
        self.quick = tiktoken.Encoding(
            "same", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}
        )

    def __call__(self, text: str) -> bytes:
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        other = len(raw) and raw.max() >= FIRST_OTHER_BYTE
        if other or (self.special and self.special.search(text)):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.quick.encode_ordinary(text)
        return np.asarray(ids, dtype="<u4").tobytes()


def cuts(total: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: the odd one first, full ones after it."""
    if total <= capacity:
        return [(0, total)]
    first = total % capacity
    starts = range(first, total, capacity)
    return ([(0, first)] if first else []) + [(s, capacity) for s in starts]


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and ids if asked for."""
    fields = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    fields += ", ids binary" if keep_ids else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encode(text.as_py() or "") + end)
                for n, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    row = (doc, n, start, length, zlib.crc32(part))
                    out.append((*row, bytes(part)) if keep_ids else row)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            columns = list(zip(*out, strict=True)) if out else [[]] * (5 + keep_ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)],
                names[: len(columns)],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, fields)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, for pieces below capacity taken in the given order."""
    open_at = np.zeros(capacity + 1, dtype=np.int64)  # by gap; full sequences are not counted
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    made = 0
    never = np.iinfo(np.int64).max
    for i, size in enumerate(lengths.tolist()):
        # change of the sum, less 2, if a sequence moves from gap g to gap g - size
        fits = open_at[size : capacity + 1]
        cost = 2 * (open_at[: capacity - size + 1] - fits)
        cost[0] = -2 * fits[0] - 1  # a full sequence has no gap to count
        cost[fits == 0] = never
        best = int(cost[:-1].argmin())
        if cost[best] != never:
            gap = best + size
            open_at[gap] -= 1
            chosen = stacks[gap].pop()
        else:
            gap, chosen, made = capacity, made, made + 1
        where[i], offset[i] = chosen, capacity - gap
        if gap > size:
            open_at[gap - size] += 1
            stacks[gap - size].append(chosen)
    return where, offset


def place(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset to pieces. ``cut`` is read twice, so give it staged.

    Full pieces fill a sequence each and are numbered without moving; only the others are dealt
    to groups.
    """
    spark = cut.sparkSession
    key = F.xxhash64(F.lit(6), "doc_id", "piece", "length", "ids_crc32")
    open_ = cut.where(F.col("length") < capacity)
    groups = max(1, -(-open_.count() // group_pieces))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        order = ["length", "doc_id", "piece", "ids_crc32"]
        group = group.sort_values(order, ascending=[False, True, True, True], kind="stable")
        where, offset = sum_of_squares(group["length"].to_numpy(), capacity)
        number = group["_group"].to_numpy(dtype="int64")
        out = group.drop(columns="_group")
        # even numbers are of packed sequences, odd ones of full pieces
        return out.assign(sequence_id=(number * (1 << 32) + where) * 2, offset=offset)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields]
    fields += ["sequence_id bigint", "offset bigint"]
    dealt = open_.withColumn("_group", F.pmod(key, F.lit(groups)))
    packed = dealt.repartition(min(groups, tasks(spark)), "_group")
    packed = packed.groupBy("_group").applyInPandas(pack, ", ".join(fields))
    full = cut.where(F.col("length") == capacity).select(
        "*",
        (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )
    return packed.unionByName(full)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    group_pieces: int = GROUP_PIECES,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces with their place. With ``keep_ids``, sorting a sequence's pieces by offset and
    joining their ids gives the training sequence."""
    cut = staged(pieces(docs, tokenizer, capacity, keep_ids), "pieces")
    return place(cut, capacity, group_pieces)
