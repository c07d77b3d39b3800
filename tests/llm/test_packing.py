import zlib

import cases
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallybook.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(PATH)


def ids_of(exact, text):
    return [*exact.encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_are_the_tokenizers_ids(spark, exact):
    rows = cases.rows()
    found = packing.pieces(cases.frame(spark, rows).repartition(3), PATH, 64, keep_ids=True)
    by_doc = {}
    for r in found.collect():
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length <= 64
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids))
        by_doc.setdefault(r.doc_id, set()).add((r.piece, r.start, tuple(ids)))
    for doc in {r[0] for r in rows if r[0] is not None}:
        ids = ids_of(exact, next(r[1] for r in rows if r[0] == doc))
        parts = sorted(by_doc[doc])
        assert [x for _, _, part in parts for x in part] == ids
        assert [p[0] for p in parts] == list(range(len(parts)))
        assert [p[1] for p in parts] == list(
            np.cumsum([0, *[len(p[2]) for p in parts[:-1]]])
        )
        assert all(len(p[2]) == 64 for p in parts[1:])


def test_places_are_gapless_and_tight(spark):
    docs = cases.documents(spark)
    found = packing.pack_documents(docs, PATH, 256, group_pieces=40).toPandas()
    assert len(found) == packing.pieces(docs, PATH, 256).count()
    for _, held in found.groupby("sequence_id"):
        held = held.sort_values("offset")
        assert held.offset.tolist() == [0, *np.cumsum(held.length)[:-1].tolist()]
        assert held.length.sum() <= 256


def test_rule_against_the_definition():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 32, 300)
    where, offset = packing.sum_of_squares(lengths, 32)
    used: dict[int, int] = {}
    for size, bin_, at in zip(lengths.tolist(), where.tolist(), offset.tolist(), strict=True):
        def cost(choice):
            gaps = dict(used)
            gaps[choice] = gaps.get(choice, 32) - size
            counts = np.bincount([g for g in gaps.values() if g > 0], minlength=33)
            return int((counts**2).sum())

        options = [b for b, g in used.items() if g >= size] or [len(used)]
        assert cost(bin_) == min(map(cost, options))
        assert at == 32 - used.get(bin_, 32)
        used[bin_] = used.get(bin_, 32) - size


def test_few_sequences():
    lengths = np.sort(np.random.default_rng(1).integers(1, 2048, 4000))[::-1]
    where, _ = packing.sum_of_squares(lengths, 2048)
    assert where.max() + 1 <= 1.01 * -(-lengths.sum() // 2048) + 1


def test_empty_table(spark):
    assert packing.pack_documents(cases.empty(spark), PATH).collect() == []


def test_quick_ids_equal_the_tokenizers_for_every_letter_they_take(exact):
    """Every code point below U+0280, alone and beside every kind of neighbour the splitting tells apart."""
    encode = packing.Encoder(PATH)
    points = [chr(c) for c in range(0x280)]
    sides = ["", "a", "Z", "é", "7", " ", "  ", "\n", "\t", "\r", "\xa0", "\x85", "'", "'s", "!", "_", "²", "ª"]
    texts = [f"{x}{c}{y}" for c in points for x in sides for y in sides]
    texts += [f"a {c}{c} {c}'ll{c}" for c in points]
    for start in range(0, len(texts), 50_000):
        some = texts[start : start + 50_000]
        slow = exact.encode_batch(some, add_special_tokens=False)
        for text, wanted in zip(some, slow, strict=True):
            assert np.frombuffer(encode(text), dtype="<u4").tolist() == wanted.ids, ascii(text)
    pairs = "".join(a + b for a in points[:0x180:7] for b in points)
    assert np.frombuffer(encode(pairs), dtype="<u4").tolist() == exact.encode(pairs, add_special_tokens=False).ids
