"""Drop lines that many documents share, with levelled runs of line hashes.

Documents come in batches. Each batch gives one run: the hashes of its distinct line keys with
the number of the batch's documents that hold them, sorted by hash. A new run is anti-joined with the keys already
known to be frequent, so these are carried no further, and is then added. When ``fanout``
runs stand on a level they are merged into one run of the next level, counts added. Every count is
complete once all runs are merged; the frequent keys then mark the lines to drop.

A key is named by two 64-bit hashes. Runs and joins carry hashes only, never text, and all of it is
DataFrame functions. A line that sits in a third of all documents is one row per task after partial
aggregation, and the join on hashes is left to Spark, which broadcasts frequent keys only while they
are small and otherwise splits skewed partitions.

Defined cases: null or empty text is one empty line and comes back as ''. Blank keys are never
dropped. A row counts as a document of its own, also where rows repeat, and repeated rows get the
same result. An empty table gives an empty result. Other columns pass through unchanged, except
n_chars, which follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallybook.llm.common import packed, staged, text_hash

BATCHES = 4
FANOUT = 2
BLANKS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """Keys of all lines: stripped at both ends, A-Z lower-cased."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.transform(F.split(lowered, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)))


def key_hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2")]


def line_runs(docs: DataFrame, batches: int = BATCHES, min_chars: int = 1) -> list[DataFrame]:
    """One sorted run (k1, k2, docs) for each batch; a batch is a hash share of the rows."""
    batch = F.pmod(F.xxhash64(F.lit(8), "doc_id", "text"), F.lit(batches)).cast("int")
    keys = F.array_distinct(line_keys(F.col("text")))
    # the hash of a text is taken before its lines are, once and not with every line
    found = (
        docs.select(batch.alias("batch"), keys.alias("_keys"))
        .select("batch", F.explode_outer("_keys"))
        .where(F.length("col") >= min_chars)
        .select("batch", *key_hashes(F.col("col")))
        .groupBy("batch", "k1", "k2")
        .agg(F.count(F.lit(1)).alias("docs"))
        .sortWithinPartitions("batch", "k1", "k2")
    )
    runs = staged(found, "line-runs", "batch")
    return [runs.where(F.col("batch") == n).drop("batch") for n in range(batches)]


def merge(runs: list[DataFrame]) -> DataFrame:
    """One sorted run with the counts of all."""
    together = runs[0]
    for run in runs[1:]:
        together = together.unionByName(run)
    return (
        together.groupBy("k1", "k2")
        .agg(F.sum("docs").alias("docs"))
        .sortWithinPartitions("k1", "k2")
    )


def frequent_keys(
    runs: list[DataFrame], min_docs: int, fanout: int = FANOUT
) -> DataFrame:
    """Keys (k1, k2) that at least ``min_docs`` documents of all runs hold."""
    levels: list[list[DataFrame]] = [[]]
    known = None
    for run in runs:
        levels[0].append(run.join(known, ["k1", "k2"], "left_anti") if known else run)
        level = 0
        while len(levels[level]) == fanout and run is not runs[-1]:
            full = staged(merge(levels[level]), "line-level")
            levels[level] = []
            reached = full.where(F.col("docs") >= min_docs).select("k1", "k2")
            known = known.unionByName(reached) if known else reached
            level += 1
            if level == len(levels):
                levels.append([])
            levels[level].append(full.where(F.col("docs") < min_docs))
    last = merge([run for level in levels for run in level])
    last = last.where(F.col("docs") >= min_docs).select("k1", "k2")
    return staged(known.unionByName(last) if known else last, "line-keys")


def dedup_lines(
    docs: DataFrame,
    min_docs: int = 10,
    min_chars: int = 1,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """The rows with their kept text in ``text``, and ``n_lines`` and ``n_dropped`` beside it."""
    keys = frequent_keys(line_runs(docs, batches, min_chars), min_docs, fanout)
    places = (
        docs.select(
            F.col("doc_id").alias("_doc"),
            text_hash(F.col("text")).alias("_text"),
            line_keys(F.col("text")).alias("_keys"),
        )
        .select("_doc", "_text", F.posexplode_outer("_keys").alias("_line", "_key"))
        .where(F.length("_key") >= min_chars)
        .select("_doc", "_text", "_line", *key_hashes(F.col("_key")))
        .join(keys, ["k1", "k2"])
        .groupBy("_doc", "_text")
        .agg(F.collect_set("_line").alias("_drop"))
    )
    old = F.col("_row.text")
    lines = split_lines(old)
    drop = F.coalesce(F.col("_drop"), F.array().cast("array<int>"))
    # places that stay, looked up in lines that are split once: linear in the lines of a text
    whole = F.array(F.struct(lines.alias("lines"), F.col("_drop").alias("drop")))
    kept = F.transform(
        whole,
        lambda t: F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(t["lines"]) - 1), t["drop"]),
            lambda n: F.get(t["lines"], n),
        ),
    )[0]
    rows = packed(docs).withColumn("_hash", text_hash(old))
    same = rows["_row.doc_id"].eqNullSafe(places["_doc"]) & (rows["_hash"] == places["_text"])
    text = F.when(F.col("_drop").isNull(), F.coalesce(old, F.lit("")))
    text = text.otherwise(F.array_join(kept, "\n"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast("bigint")
    return rows.join(places, same, "left").select(
        *[
            new.get(c, F.col(f"_row.`{c}`")).alias(c)
            for c in docs.columns
            if c not in ("n_lines", "n_dropped")
        ],
        F.size(lines).cast("bigint").alias("n_lines"),
        F.size(drop).cast("bigint").alias("n_dropped"),
    )
