"""Documents with every awkward case, and brute-force versions of the operators."""

import random
import re

from pyspark.sql import types as T

CLASHING = ["size", "score", "_text", "_row", "_hash", "_drop", "_doc", "n_lines", "shard", "words"]
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(name, T.StringType()) for name in CLASHING],
    ]
)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\f\r"


def prose(rng, words, alphabet="abcdefgh"):
    return " ".join(
        "".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(words)
    )


def rows(seed=1, n=60):
    rng = random.Random(seed)
    passage = prose(rng, 120)
    out = []
    for i in range(n):
        text = prose(rng, rng.randint(1, 150))
        if i % 4 == 0:
            text += "\n  Shared LINE here \t\n" + prose(rng, 5)
        if i % 7 == 0:
            text = text[: len(text) // 2] + "\n" + passage + "\n" + text[len(text) // 2 :]
        if i % 9 == 0 and out:
            text = out[-1][1]  # copy
        if i % 10 == 0 and out and out[-3 % len(out)][1]:
            text = out[-3 % len(out)][1] + " x"  # near copy
        out.append((i, text, "ab"[i % 2], f"s{i % 5}", len(text or "")))
    long = prose(rng, 20_000)
    out += [
        (1000, None, None, "s0", None),
        (1001, "", "a", None, 0),
        (1002, " \t\r\n \x0b", "a", "s1", 5),
        (1003, long, "b", "s0", len(long)),
        (1004, "日本語のテキスト " * 30 + "<|endoftext|> İıſK", "a", "s2", 300),
        (1005, "x" * 900, "b", "only-source", 900),
        (1006, "\n\n\n", None, None, 3),
        (None, "row without an id", "a", "s3", 17),
        (None, None, None, None, None),
    ]
    out += [out[3], out[3], out[60], out[61]]  # repeated rows
    return out


def frame(spark, some):
    return spark.createDataFrame([(*r, *CLASHING) for r in some], SCHEMA)


def documents(spark, seed=1, n=60):
    return frame(spark, rows(seed, n)).repartition(3)


def empty(spark):
    return frame(spark, [])


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
