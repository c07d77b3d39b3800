"""Exact token counts of texts that arrive in lines and need not fit in a row.

A tokenizer that splits text before merging gives the same count for the parts as for the whole
where the text is cut between two of its own splits. ``cuts`` names such places. The lines of a request
are dealt to blocks. A block reads its lines in order, counts up to the last cut whenever a chunk is
full and keeps only what follows; it hands on its count, the text before its first cut and the
text after its last one. Those ends are a word or two each: joined in the order of blocks they are
the seams, which are counted like any other text. Blocks of one long request run side by side.

Defined cases: a NULL text is empty. A request without text counts 0. Where a text has no cut at all, it is kept
whole until one comes, so the count is right and memory follows that stretch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallybook import schemas as S
from tallybook.functions.tokens import CounterFor, model_counter, text_counter
from tallybook.operators.skew import salted_join

# Between a letter or digit and a blank: byte-level splitters start a new word there, whatever surrounds it.
WORD_THEN_BLANK = r"(?<=[^\W_])(?= )"
BLOCK_LINES = 65_536
CHUNK_CHARS = 1 << 20


class _Block:
    """One block: what is counted, the text before the first cut, and the text not yet counted."""

    def __init__(self, counter: Callable[[str], int] | None, cuts: re.Pattern, chunk: int):
        self.counter, self.cuts, self.chunk = counter, cuts, chunk
        self.tokens, self.head = 0, None
        self.parts: list[str] = []
        self.held, self.full = 0, chunk

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.held += len(text)
        if self.held >= self.full:
            self.settle()
            # without a cut the next look waits for twice the text, so that looking stays linear
            self.full = max(self.chunk, 2 * self.held)

    def settle(self) -> None:
        text = "".join(self.parts)
        places = [m.start() for m in self.cuts.finditer(text) if 0 < m.start() < len(text)]
        if places:
            first, last = places[0], places[-1]
            if self.head is None:
                self.head = text[:first]
            else:
                first = 0
            if self.counter is not None and last > first:
                self.tokens += self.counter(text[first:last])
            text = text[last:]
        self.parts, self.held = [text], len(text)

    def ends(self) -> tuple[int, str | None, str]:
        self.settle()
        return self.tokens, self.head, self.parts[0]


def block_counts(
    texts: DataFrame,
    counter_of: Callable[[str | None], Callable[[str], int] | None],
    cuts: str = WORD_THEN_BLANK,
    block_lines: int = BLOCK_LINES,
    chunk: int = CHUNK_CHARS,
) -> DataFrame:
    """request_id, model, block, tokens, head (NULL: no cut in the block), tail.

    ``texts`` has request_id, seq, text and model.
    """
    request = texts.schema["request_id"].dataType.simpleString()
    fields = f"request_id {request}, model string, block bigint, tokens bigint, head string, tail string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        places, counters = re.compile(cuts), {}
        now, state = None, None
        done: list[tuple] = []

        def flush():
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, schema, strict=True)],
                ["request_id", "model", "block", "tokens", "head", "tail"],
            )

        for batch in batches:
            names = batch.schema.names
            kind = batch.schema.field(names.index("request_id")).type
            schema = [kind, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            rows = zip(
                *(batch.column(names.index(c)).to_pylist() for c in ("request_id", "model", "_block")),
                batch.column(names.index("text")),
                strict=True,
            )
            for request_id, model, block, text in rows:
                if (request_id, block) != now:
                    if state is not None:
                        done.append((now[0], of, now[1], *state.ends()))
                    if model not in counters:
                        counters[model] = counter_of(model)
                    now, of = (request_id, block), model
                    state = _Block(counters[model], places, chunk)
                state.add(text.as_py() or "")
            if done:
                yield flush()
        if state is not None:
            done.append((now[0], of, now[1], *state.ends()))
            yield flush()

    rows = texts.select(
        "request_id", "seq", "text", "model", F.floor(F.col("seq") / block_lines).alias("_block")
    )
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "request_id", "_block")
    return dealt.sortWithinPartitions("request_id", "_block", "seq", "text").mapInArrow(work, fields)


def seams(blocks: DataFrame) -> DataFrame:
    """request_id, model, tokens, seams: what blocks have counted, and the texts between them in order."""
    ends = F.array_sort(F.collect_list(F.struct("block", "head", "tail")))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("shut"))

    def follow(state, part):
        joined = F.concat(state["open"], F.coalesce(part["head"], part["tail"]))
        return F.when(
            part["head"].isNull(), F.struct(joined.alias("open"), state["shut"].alias("shut"))
        ).otherwise(
            F.struct(part["tail"].alias("open"), F.concat(state["shut"], F.array(joined)).alias("shut"))
        )

    whole = F.aggregate(
        "_ends", start, follow, lambda s: F.concat(s["shut"], F.array(s["open"]))
    )
    return (
        blocks.groupBy("request_id", "model")
        .agg(F.sum("tokens").alias("tokens"), ends.alias("_ends"))
        .select("request_id", "model", "tokens", F.filter(whole, lambda t: t != "").alias("seams"))
    )


def long_counts(
    texts: DataFrame,
    *,
    tokenizer: Callable[[str], int] | None = None,
    counter_for: CounterFor | None = None,
    models: DataFrame | None = None,
    cuts: str = WORD_THEN_BLANK,
    block_lines: int = BLOCK_LINES,
    chunk: int = CHUNK_CHARS,
) -> DataFrame:
    """request_id, tokens, exact from lines (request_id, seq, text).

    With ``counter_for`` the tokenizer is that of the request's model; ``tokens`` is NULL and ``exact`` false
    where a model has none.
    """
    if tokenizer is not None:
        found = block_counts(
            texts.withColumn("model", F.lit("")), lambda _: tokenizer, cuts, block_lines, chunk
        )
        each = seams(found).select("request_id", "tokens", F.explode_outer("seams").alias("_seam"))
        return each.groupBy("request_id").agg(
            (F.max("tokens") + F.sum(text_counter(tokenizer)(F.col("_seam")))).alias("tokens"),
            F.lit(True).alias("exact"),
        )
    named = salted_join(texts, models.select("request_id", "model"), ["request_id"], "left")
    named = named.withColumn("model", F.coalesce("model", F.lit(S.UNKNOWN_MODEL)))
    found = seams(block_counts(named, counter_for, cuts, block_lines, chunk))
    counted = found.withColumn("_seams", model_counter(counter_for)(F.col("seams"), F.col("model")))
    exact = F.col("_seams.exact")
    return counted.select(
        "request_id", F.when(exact, F.col("tokens") + F.col("_seams.tokens")).alias("tokens"), exact.alias("exact")
    )
