"""Mix sources to target weights with exact quotas of blocks.

Targets: sources in code point order, the null source last, share ``factor`` times all words by
repeating weights. A target stops at ``most`` times its source's words; the excess goes to the
others by weight until none is above, which is one water level over the sorted ratios.

Blocks: a source's documents stand in a hashed order and make one stream of words, cut into at
most ``blocks`` blocks. Whole passes over the stream take every block; the rest of the target
takes as many permuted blocks as it needs, the last one trimmed, so a source gives its target to the word.

Splitting tree: the quotas are split between two halves of the output shards by a multivariate
hypergeometric draw, source by source, and the halves are split again until each shard has its own
quota. A shard then takes its own interval of each source's permuted blocks, so shards share no
block of a pass, and orders its slices by a hash.

All of it is DataFrame functions. Only the tree's nodes hold one entry per source; positions in a stream
are summed in hashed buckets first, so one source with a third of all rows is many tasks.

Defined cases: null text has no words and is never taken. Equal rows are told apart by a number and
are taken each on its own. Sources without words have target 0. An empty table gives an empty
result. Extra columns are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallybook.llm.common import packed, staged, text_hash, uniform

WEIGHTS = (3, 1, 2)
FACTOR = 1.5
MOST = 2.0
BLOCKS = 16_384
LEAST_BLOCK = 64
SHARDS_LOG2 = 3
BUCKET_ROWS = 8_192
SPREAD = 9
WORD = r"[^\x20\x09-\x0D]+"
WORD_AND_GAP = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def sized_rows(docs: DataFrame) -> DataFrame:
    """doc_id, _text, _copy, source, size: a row per document, equal rows numbered."""
    rows = docs.select(
        "doc_id",
        text_hash(F.col("text")).alias("_text"),
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
    )
    counted = rows.groupBy("doc_id", "_text", "source", "size").agg(F.count(F.lit(1)).alias("_n"))
    numbered = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")))
    return numbered.drop("_n")


def source_targets(
    sized: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    factor: float = FACTOR,
    most: float = MOST,
) -> DataFrame:
    """source, source_no, source_size, target: a row per source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ratio = F.col("cap") / F.col("weight")
    sources = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("source_no", F.row_number().over(by_name))
        .withColumn(
            "weight",
            F.element_at(
                F.array(*[F.lit(float(w)) for w in weights]),
                ((F.col("source_no") - 1) % len(weights) + 1).cast("int"),
            ),
        )
        .withColumn("cap", F.col("source_size") * most)
    )
    rising = Window.orderBy(ratio, "source_no")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    # the level if all sources before this one stop at their cap; the first that holds is it, and
    # stopping more sources than that only lowers it
    level = (
        F.sum("source_size").over(everything) * factor
        - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(after)
    return (
        sources.withColumn("level", level)
        .withColumn("_holds", F.when(F.col("level") <= ratio, F.col("level")))
        .withColumn("_level", F.max("_holds").over(everything))
        .withColumn(
            "target",
            F.least("cap", F.coalesce(F.col("weight") * F.col("_level"), F.col("cap"))),
        )
        .select("source", "source_no", "source_size", "target")
    )


def stream_positions(sized: DataFrame, seed: int) -> DataFrame:
    """Add ``start``: the words of the source that stand before the row in hashed order."""
    rows = sized.count()
    bits = max(0, (rows // BUCKET_ROWS).bit_length())
    order = F.xxhash64(F.lit(seed), "doc_id", "_text", "_copy")
    keyed = sized.withColumn("_order", order).withColumn(
        "_bucket", F.shiftrightunsigned("_order", 64 - bits) if bits else F.lit(0).cast("bigint")
    )
    inside = Window.partitionBy("source_no", "_bucket").orderBy("_order", "doc_id", "_text", "_copy")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy("source_no", "_bucket").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source_no").orderBy("_bucket")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "source_no", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset")
    )
    return (
        keyed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, ["source_no", "_bucket"])
        .withColumn("start", F.col("_offset") + F.col("_inside"))
        .drop("_offset", "_inside", "_bucket", "_order")
    )


def block_plan(targets: DataFrame, blocks: int = BLOCKS, least: int = LEAST_BLOCK) -> DataFrame:
    """Per source: block words, blocks of a pass, whole passes, rest in words, quota in blocks."""
    size, words = F.col("source_size"), F.col("block_words")
    return (
        targets.where(size > 0)
        .withColumn("block_words", F.greatest(F.lit(least), F.ceil(size / blocks)).cast("bigint"))
        .withColumn("pass_blocks", F.ceil(size / words).cast("bigint"))
        .withColumn("wanted", F.round("target").cast("bigint"))
        .withColumn("passes", F.expr("wanted div source_size"))
        .withColumn("rest", F.col("wanted") - F.col("passes") * size)
        .withColumn(
            "quota",
            F.col("passes") * F.col("pass_blocks") + F.ceil(F.col("rest") / words).cast("bigint"),
        )
    )


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Marked items among ``drawn`` of ``total``, by inversion of the distribution at ``u``.

    Probabilities follow from one value to the next; those over SPREAD deviations from the
    mean are below the precision of a double and are left out.
    """
    low = F.greatest(F.lit(0).cast("bigint"), drawn - (total - marked))
    high = F.least(marked, drawn)
    share = marked / F.greatest(total, F.lit(1))
    mean = drawn * share
    spread = F.sqrt(mean * (1 - share) * (total - drawn) / F.greatest(total - 1, F.lit(1)))
    first = F.greatest(low, F.floor(mean - SPREAD * spread - 1))
    last = F.least(high, F.ceil(mean + SPREAD * spread + 1))

    def following(weight: Column, x: Column) -> Column:
        up = (marked - x).cast("double") * (drawn - x).cast("double")
        down = (x + 1).cast("double") * (total - marked - drawn + x + 1).cast("double")
        return weight * up / down

    steps = F.when(last > first, F.sequence(first, last - 1)).otherwise(
        F.array().cast("array<bigint>")
    )
    one = F.lit(1.0)
    whole = F.aggregate(
        steps,
        F.struct(one.alias("w"), one.alias("sum")),
        lambda s, x: F.struct(
            following(s["w"], x).alias("w"), (s["sum"] + following(s["w"], x)).alias("sum")
        ),
        lambda s: s["sum"],
    )
    start = F.struct(one.alias("w"), one.alias("sum"), first.alias("x"), whole.alias("whole"))
    return F.aggregate(
        steps,
        start,
        lambda s, x: F.struct(
            following(s["w"], x).alias("w"),
            (s["sum"] + following(s["w"], x)).alias("sum"),
            F.when(s["sum"] <= u * s["whole"], x + 1).otherwise(s["x"]).alias("x"),
            s["whole"].alias("whole"),
        ),
        lambda s: s["x"],
    )


def split_quotas(plan: DataFrame, depth: int, seed: int) -> DataFrame:
    """shard, source_no, first, taken: the interval of the source's drawn blocks a shard gets."""
    entry = F.struct("source_no", "quota")
    nodes = plan.agg(F.array_sort(F.collect_list(entry)).alias("quotas")).select(
        F.lit(0).alias("node"), "quotas"
    )
    for level in range(depth):
        at_level = F.lit(seed * 64 + level)
        total = F.aggregate("quotas", F.lit(0).cast("bigint"), lambda s, q: s + q["quota"])
        start = F.struct(
            F.col("_all").alias("left"),
            F.expr("_all div 2").alias("draws"),
            F.array().cast("array<bigint>").alias("taken"),
        )

        def draw(state: Column, q: Column) -> Column:
            u = uniform(at_level, F.col("node"), q["source_no"])
            x = hypergeometric(state["left"], q["quota"], state["draws"], u)
            return F.struct(
                (state["left"] - q["quota"]).alias("left"),
                (state["draws"] - x).alias("draws"),
                F.concat(state["taken"], F.array(x)).alias("taken"),
            )

        split = nodes.withColumn("_all", total).withColumn(
            "_left", F.aggregate("quotas", start, draw, lambda s: s["taken"])
        )
        halves = F.array(
            F.struct(
                (F.col("node") * 2).alias("node"),
                F.zip_with(
                    "quotas",
                    "_left",
                    lambda q, x: F.struct(q["source_no"].alias("source_no"), x.alias("quota")),
                ).alias("quotas"),
            ),
            F.struct(
                (F.col("node") * 2 + 1).alias("node"),
                F.zip_with(
                    "quotas",
                    "_left",
                    lambda q, x: F.struct(
                        q["source_no"].alias("source_no"), (q["quota"] - x).alias("quota")
                    ),
                ).alias("quotas"),
            ),
        )
        nodes = split.select(F.inline(halves))
    shares = nodes.select(F.col("node").alias("shard"), F.inline("quotas"))
    before = Window.partitionBy("source_no").orderBy("shard")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    return shares.select(
        "shard",
        "source_no",
        F.coalesce(F.sum("quota").over(before), F.lit(0)).alias("first"),
        F.col("quota").alias("taken"),
    ).where(F.col("taken") > 0)


def drawn_blocks(plan: DataFrame, shares: DataFrame, seed: int) -> DataFrame:
    """source_no, block, epoch, shard, words: every block the mix takes."""
    last = F.col("pass_blocks") - 1
    every = plan.select(
        "source_no",
        "pass_blocks",
        "block_words",
        "source_size",
        "passes",
        "rest",
        F.explode(F.sequence(F.lit(0).cast("bigint"), "passes")).alias("epoch"),
    ).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    # the short block at the end of a stream comes last, so that only it and the trimmed one differ
    permuted = Window.partitionBy("source_no", "epoch").orderBy(
        F.col("block") == last, F.xxhash64(F.lit(seed), "source_no", "epoch", "block"), "block"
    )
    length = F.least(
        F.col("block_words"), F.col("source_size") - F.col("block") * F.col("block_words")
    )
    rank = F.col("_rank")
    left = F.col("rest") - rank * F.col("block_words")
    words = F.when(F.col("epoch") < F.col("passes"), length).otherwise(F.least(length, left))
    ranked = (
        every.withColumn("_rank", (F.row_number().over(permuted) - 1).cast("bigint"))
        .withColumn("words", words)
        .where(F.col("words") > 0)
        .withColumn("_at", F.col("epoch") * F.col("pass_blocks") + rank)
    )
    # a shard's interval starts at some place of the source's drawn blocks; the last start wins
    starts = shares.select("source_no", F.col("first").alias("_at"), "shard")
    along = Window.partitionBy("source_no").orderBy("_at", F.col("block").isNotNull())
    return (
        ranked.select("source_no", "_at", "block", "epoch", "words")
        .unionByName(starts, allowMissingColumns=True)
        .withColumn("shard", F.last("shard", ignorenulls=True).over(along))
        .where(F.col("block").isNotNull())
        .drop("_at")
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    factor: float = FACTOR,
    most: float = MOST,
    shards_log2: int = SHARDS_LOG2,
    seed: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """The sized rows with their source's target, and the slices the mix takes from them.

    A slice is (doc_id, _text, source, _copy, shard, epoch, first_word, words, shuffle_key);
    ``shuffled`` brings the slices of each shard in their order.
    """
    sized = staged(sized_rows(docs), "sized")
    targets = staged(source_targets(sized, weights, factor, most), "targets")
    same = sized["source"].eqNullSafe(targets["source"])
    rows = sized.join(targets, same).drop(targets["source"])
    plan = block_plan(targets)
    shares = staged(split_quotas(plan, shards_log2, seed), "shares")
    blocks = drawn_blocks(plan, shares, seed)
    words = plan.select("source_no", "block_words")
    placed = stream_positions(rows.where(F.col("size") > 0), seed).join(words, "source_no")
    cut = placed.select(
        "doc_id",
        "_text",
        "_copy",
        "source",
        "source_no",
        "size",
        "start",
        "block_words",
        F.explode(
            F.sequence(F.expr("start div block_words"), F.expr("(start + size - 1) div block_words"))
        ).alias("block"),
    )
    low = F.greatest(F.col("start"), F.col("block") * F.col("block_words"))
    high = F.least(
        F.col("start") + F.col("size"), F.col("block") * F.col("block_words") + F.col("words")
    )
    slices = (
        cut.join(blocks, ["source_no", "block"])
        .withColumn("first_word", low - F.col("start"))
        .withColumn("words", high - low)
        .where(F.col("words") > 0)
        .select(
            "doc_id",
            "_text",
            "_copy",
            "source",
            "shard",
            "epoch",
            "first_word",
            "words",
            F.xxhash64(F.lit(seed), "shard", "epoch", "doc_id", "_copy", "block").alias(
                "shuffle_key"
            ),
        )
    )
    kept = ["doc_id", "_text", "source", "_copy", "size", "source_size", "target"]
    return rows.select(*kept), slices


def shuffled(slices: DataFrame, shards_log2: int = SHARDS_LOG2) -> DataFrame:
    """The slices a shard to a partition, each shard in its own random order."""
    dealt = slices.repartition(1 << shards_log2, "shard")
    return dealt.sortWithinPartitions("shard", "shuffle_key", "doc_id", "first_word")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards: a row per document.

    ``shards`` are the output shards that the splitting tree gave its words to, in order.
    """
    rows, slices = mix(docs, **options)
    keys = ["doc_id", "_text", "source", "_copy"]
    taken = slices.groupBy(*keys).agg(
        F.sum("words").alias("taken"), F.array_sort(F.collect_set("shard")).alias("shards")
    )
    taken = taken.select(*[F.col(k).alias(f"t{k}") for k in keys], "taken", "shards")
    same = rows["doc_id"].eqNullSafe(taken["tdoc_id"])
    same &= rows["source"].eqNullSafe(taken["tsource"])
    same &= (rows["_text"] == taken["t_text"]) & (rows["_copy"] == taken["t_copy"])
    return rows.join(taken, same, "left").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).alias("taken"),
        F.coalesce("shards", F.array().cast("array<int>")).alias("shards"),
    )


def taken_texts(docs: DataFrame, slices: DataFrame, *parts_of: str) -> DataFrame:
    """_row, the columns of ``parts_of``, _key, _words, _out: the words the mix takes of each document, a row per part."""
    parts = slices.groupBy("doc_id", "_text", "source", "_copy", *parts_of).agg(
        F.array_sort(F.collect_list(F.struct("first_word", "words"))).alias("_parts"),
        F.sum("words").alias("_words"),
        F.min("shuffle_key").alias("_key"),
    )
    # a copy is a row of its own, so of equal rows each takes its own number
    old = F.col("_row.text")
    each = packed(docs).select(
        "_row",
        F.col("_row.doc_id").alias("_doc"),
        F.col("_row.source").alias("_source"),
        text_hash(old).alias("_hash"),
    )
    once = each.dropDuplicates(["_doc", "_source", "_hash"])
    same = once["_doc"].eqNullSafe(parts["doc_id"]) & once["_source"].eqNullSafe(parts["source"])
    same &= once["_hash"] == parts["_text"]
    tokens = F.regexp_extract_all(old, F.lit(WORD_AND_GAP), F.lit(0))
    stretch = F.transform(
        "_parts",
        lambda p: F.array_join(
            F.slice(tokens, (p["first_word"] + 1).cast("int"), p["words"].cast("int")), ""
        ),
    )
    size = F.regexp_count(old, F.lit(WORD))
    text = F.when(F.col("_words") == size, old).otherwise(F.array_join(stretch, ""))
    return once.join(parts, same).select("_row", *parts_of, "_key", "_words", text.alias("_out"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each pass that takes words of a document.

    A document taken whole keeps its text; of one taken in part the taken stretches stay,
    with the white space inside them.
    """
    _, slices = mix(docs, **options)
    out = taken_texts(docs, slices, "epoch")
    return out.select(*with_text(docs))


def with_text(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` with the taken text in place of the whole one."""
    new = {"text": F.col("_out")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_out").cast("bigint")
    return [new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns]


def write_shards(docs: DataFrame, path: str, shards_log2: int = SHARDS_LOG2, **options) -> DataFrame:
    """The mix written as the splitting tree deals it: a folder a shard, each in its own random order.

    Returns shard, words, rows for each shard. A written row is what a shard takes of a document in a pass: words, and
    ``document`` with the columns of ``docs``, whatever their names. A document whose words go to two shards has a row in
    both. A shard without words has no folder; an empty mix writes none.
    """
    _, slices = mix(docs, shards_log2=shards_log2, **options)
    parts = taken_texts(docs, slices, "epoch", "shard")
    dealt = parts.repartition(1 << shards_log2, "shard").sortWithinPartitions("shard", "_key", "epoch")
    rows = dealt.select("shard", F.col("_words").alias("words"), F.struct(*with_text(docs)).alias("document"))
    rows.write.partitionBy("shard").parquet(path)
    kept = docs.sparkSession.read.schema(rows.schema).parquet(path)
    return kept.groupBy("shard").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("rows"))
