"""Token counts of long streams in parts: the count of the whole text, without the whole text."""

import random
import resource

import pytest
import tiktoken
from pyspark.sql import functions as F

from tallybook.operators import long_text, metering

# A byte-level splitter over single bytes: the count shows where words were cut, as pairs inside a word merge.
SPLIT = r"'s|'t| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"


def splitter():
    """A counter that travels to workers by value, which do not know this file."""

    def count(text):
        ranks = {bytes([n]): n for n in range(256)} | {b"ab": 256, b" a": 257, b"abab": 258, b"  ": 259}
        encoding = tiktoken.Encoding("t", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return len(encoding.encode_ordinary(text))

    return count


by_words = splitter()


def lines_of(spark, texts):
    rows = [(r, n, t) for r, parts in texts.items() for n, t in enumerate(parts)]
    random.Random(4).shuffle(rows)
    return spark.createDataFrame(rows, "request_id string, seq bigint, text string")


def streams(seed):
    rng = random.Random(seed)
    words = ["ab", "abab", "a b", " ", "  ", "\n", "x's", "1 2", "!", "é ", "", None, "ababab ", "\t a"]
    texts = {f"r{n}": [rng.choice(words) for _ in range(rng.randrange(60))] for n in range(30)}
    return texts | {"nothing": [None, ""], "no cut": ["ab"] * 50, "blanks": [" "] * 40}


@pytest.mark.parametrize(("block", "chunk"), [(1, 1), (7, 3), (16, 1 << 20)])
def test_parts_count_like_the_whole(spark, block, chunk):
    texts = streams(block)
    found = long_text.long_counts(
        lines_of(spark, texts), tokenizer=by_words, block_lines=block, chunk=chunk
    )
    found = {r["request_id"]: r["tokens"] for r in found.collect()}
    wanted = {r: by_words("".join(t or "" for t in parts)) for r, parts in texts.items() if parts}
    assert found == wanted


def test_models_without_a_tokenizer_are_estimated(spark):
    def body(text):
        return 'data: {"choices": [{"delta": {"content": "%s"}}]}' % text

    rows = [(r, n, body(t), 0) for r in ("x", "y", "z") for n, t in enumerate(["abab a", "bab ab", " ab"])]
    lines = spark.createDataFrame(rows, "request_id string, seq bigint, line string, arrived_ms bigint")
    models = spark.createDataFrame([("x", "known"), ("y", "other")], "request_id string, model string")

    def counter_for(model):
        return by_words if model == "known" else None

    def counts(**options):
        rows = metering.meter_streams(lines, counter_for=counter_for, models=models, **options)
        return {r["request_id"]: (r["completion_tokens"], r["exact"]) for r in rows.collect()}

    found = counts(cuts=long_text.WORD_THEN_BLANK)
    assert found == counts()
    assert found["x"] == (by_words("abab abab ab ab"), True) and not found["y"][1]
    whole = metering.meter_streams(lines, tokenizer=by_words)
    parts = metering.meter_streams(lines, tokenizer=by_words, cuts=long_text.WORD_THEN_BLANK)
    assert sorted(whole.collect()) == sorted(parts.collect())


def test_a_stream_of_100_mb_is_counted_in_blocks(spark):
    """One request of 100 MB; no block hands on more than the words at its ends."""
    lines = spark.range(100_000).select(
        F.lit("long").alias("request_id"), F.col("id").alias("seq"), F.lit("ab " * 350).alias("text")
    )

    def counter(text):
        peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss  # KB
        assert len(text) <= 2 * long_text.CHUNK_CHARS and peak < 1_500_000
        return text.count("ab")

    blocks = long_text.block_counts(
        lines.withColumn("model", F.lit("")), lambda _: counter, block_lines=4096
    )
    ends = blocks.agg(F.max(F.length("head") + F.length("tail")).alias("n"), F.count("*").alias("b")).first()
    assert ends["b"] == 25 and ends["n"] < 10
    (row,) = long_text.long_counts(lines, tokenizer=counter, block_lines=4096).collect()
    assert row["tokens"] == 35_000_000
