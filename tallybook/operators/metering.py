"""Count tokens off captured stream lines.

Lines are rows (request_id, seq, line, arrived_ms), seq counting from 0 within a request.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tallybook import schemas as S
from tallybook.functions import sse
from tallybook.functions.tokens import CounterFor, model_counter, text_counter, tokens_for_length
from tallybook.operators.long_text import long_counts
from tallybook.operators.skew import heavy_keys, running_sum, salted_join

MAX_ATTEMPTS = 2
ADMISSION_SEQ = -1


def decode_lines(lines: DataFrame) -> DataFrame:
    """Adds ``done``, ``chars`` and ``usage``. A line that is not a chunk counts nothing."""
    body = sse.payload(F.col("line"))
    return (
        lines.withColumn("_body", body)
        .withColumn("done", sse.is_done(F.col("_body")))
        .withColumn("_chunk", sse.chunk(F.col("_body")))
        .withColumn("chars", sse.content_length(F.col("_chunk")))
        .withColumn("usage", F.col("_chunk.usage"))
        .drop("_body", "_chunk")
    )


def meter_streams(
    lines: DataFrame,
    *,
    tokenizer: Callable[[str], int] | None = None,
    counter_for: CounterFor | None = None,
    models: DataFrame | None = None,
    cuts: str | None = None,
) -> DataFrame:
    """Both ledgers of each request, from its lines alone.

    The count is over the joined text, so characters are summed first and turned into tokens once.
    The last usage block wins; a report exists only if it gives completion tokens. With a
    ``tokenizer`` the text of each request is put together in order and counted by it; with
    ``counter_for`` each model's own tokenizer counts (see ``model_counter``) and ``exact`` is said
    per request. ``models`` gives request_id and model, one row per request. ``cuts`` names places
    where the tokenizer splits text in any case (see ``long_text``): texts are then counted in parts and never
    put together, and a request may be longer than a row.
    """
    if counter_for is not None and (tokenizer is not None or models is None):
        raise ValueError("counter_for needs models and excludes tokenizer")
    decoded = decode_lines(lines)
    reported = F.col("usage").isNotNull()
    at = F.when(reported, F.col("seq"))
    aggregates = [
        F.sum("chars").alias("_chars"),
        F.bool_or("done").alias("saw_done"),
        F.max_by("usage.prompt_tokens", at).alias("_prompt"),
        F.max_by("usage.completion_tokens", at).alias("provider_completion_tokens"),
    ]
    completion = tokens_for_length(F.col("_chars"))
    exact = F.lit(tokenizer is not None)
    if tokenizer is not None or counter_for is not None:
        text = sse.content_text(sse.chunk(sse.payload(F.col("line"))))
        decoded = decoded.withColumn("_text", text)
    by_parts = cuts is not None and (tokenizer is not None or counter_for is not None)
    if not by_parts and (tokenizer is not None or counter_for is not None):
        aggregates.append(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("seq", "_text"))), lambda p: p["_text"]
                ),
                "",
            ).alias("_joined")
        )
    requests = decoded.groupBy("request_id").agg(*aggregates)
    if by_parts:
        counts = long_counts(
            decoded.select("request_id", "seq", F.col("_text").alias("text")),
            tokenizer=tokenizer, counter_for=counter_for, models=models, cuts=cuts,
        )
        requests = requests.join(counts, "request_id", "left")
        completion, exact = F.coalesce("tokens", completion), F.col("exact")
    elif tokenizer is not None:
        completion = text_counter(tokenizer)(F.col("_joined"))
    elif counter_for is not None:
        counted = model_counter(counter_for)(F.array("_joined"), F.col("model"))
        requests = requests.join(models.select("request_id", "model"), "request_id", "left")
        requests = requests.withColumn("_counted", counted)
        completion, exact = F.col("_counted.tokens"), F.col("_counted.exact")
    return (
        requests.select(
            "request_id",
            completion.alias("completion_tokens"),
            "saw_done",
            F.when(
                F.col("provider_completion_tokens").isNotNull(), F.coalesce("_prompt", F.lit(0))
            )
            .cast("bigint")
            .alias("provider_prompt_tokens"),
            "provider_completion_tokens",
            exact.alias("exact"),
        )
    )


def metered_rows(metered: DataFrame, requests: DataFrame) -> DataFrame:
    """Ledger A: stream counts with the facts of each request (one row per request)."""
    facts = requests.select(
        "request_id", "idempotency_key", "tenant_id", "model", "prompt_tokens", "terminal_state",
        "ended_at",
    )
    return (
        facts.join(metered.select("request_id", "completion_tokens"), "request_id", "left")
        .withColumn("completion_tokens", F.coalesce("completion_tokens", F.lit(0)))
        .select(*[f.name for f in S.METERED_SCHEMA.fields])
    )


def usage_rows(metered: DataFrame, requests: DataFrame) -> DataFrame:
    """Ledger B: a row for each stream whose provider reported its completion tokens."""
    return (
        metered.where(F.col("provider_completion_tokens").isNotNull())
        .join(requests.select("request_id", "ended_at"), "request_id")
        .select(
            "request_id",
            F.col("provider_prompt_tokens").alias("prompt_tokens"),
            F.col("provider_completion_tokens").alias("completion_tokens"),
            F.col("ended_at").alias("reported_at"),
        )
    )


def running_tokens(lines: DataFrame, *, block: int | None = None) -> DataFrame:
    """The token count after each line and before it.

    Only counts are shuffled, never text. The lines are decoded once for the block sums and once for
    the counts; store ``decode_lines`` first where that matters, it is taken as it is.
    """
    options = {"block": block} if block else {}
    decoded = lines if "chars" in lines.columns else decode_lines(lines)
    totals = running_sum(
        decoded.select("request_id", "seq", "arrived_ms", "chars"),
        ["request_id"],
        "seq",
        {"_upto": F.col("chars")},
        **options,
    )
    return totals.withColumns(
        {
            "running_tokens": tokens_for_length(F.col("_upto")),
            "previous_tokens": tokens_for_length(F.col("_upto") - F.col("chars")),
        }
    ).drop("_upto")


def first_tokens(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """Seconds from opening to the first line that brought the count above zero.

    The first line with any text does so, because any text counts at least one token: the minimum
    needs no running count. ``requests`` gives request_id and opened_ms.
    """
    first = (
        decode_lines(lines)
        .where("chars > 0")
        .groupBy("request_id")
        .agg(F.min("arrived_ms").alias("_first_ms"))
    )
    return first.join(requests.select("request_id", "opened_ms"), "request_id").select(
        "request_id", ((F.col("_first_ms") - F.col("opened_ms")) / 1000.0).alias("ttft_seconds")
    )


def midstream_draws(
    lines: DataFrame, requests: DataFrame, *, block: int | None = None
) -> DataFrame:
    """The budget draws a stream makes beyond what its admission covered.

    ``requests`` gives request_id, tenant_id, prompt_tokens and admitted. Each line draws only the
    part of the total that neither the admission nor an earlier line has drawn.
    """
    facts = requests.select("request_id", "tenant_id", "prompt_tokens", "admitted")
    heavy = heavy_keys(lines, ["request_id"])
    totals = salted_join(running_tokens(lines, block=block), facts, ["request_id"], heavy=heavy)
    drawn = F.greatest(F.col("admitted"), F.col("prompt_tokens") + F.col("previous_tokens"))
    return totals.withColumn(
        "tokens", F.col("prompt_tokens") + F.col("running_tokens") - drawn
    ).where("tokens > 0").select("tenant_id", "request_id", "seq", "arrived_ms", "tokens")


def admission_draws(requests: DataFrame) -> DataFrame:
    """What each request draws to be let in, in the shape of mid-stream draws with ``seq`` -1.

    ``requests`` gives request_id, tenant_id, opened_ms and admitted.
    """
    return requests.select(
        "tenant_id",
        "request_id",
        F.lit(ADMISSION_SEQ).cast("bigint").alias("seq"),
        F.col("opened_ms").cast("bigint").alias("arrived_ms"),
        F.col("admitted").cast("bigint").alias("tokens"),
    )


def billable_attempt(attempts: DataFrame) -> DataFrame:
    """The one attempt of each request that goes to the ledger.

    The second attempt counts only if the first failed without producing a token; there is no third.
    """
    fields = F.struct("attempt", "tokens", "failed", "tenant_id")
    picked = (
        attempts.where(F.col("attempt") <= MAX_ATTEMPTS)
        .groupBy("request_id")
        .agg(*[F.max(F.when(F.col("attempt") == n, fields)).alias(f"_{n}") for n in (1, 2)])
        .withColumn("retried", F.col("_1.failed") & (F.col("_1.tokens") == 0))
        .withColumn(
            "_used", F.when(F.col("retried") & F.col("_2").isNotNull(), F.col("_2")).otherwise(F.col("_1"))
        )
    )
    return picked.select(
        "request_id",
        "_used.tenant_id",
        "_used.attempt",
        "_used.tokens",
        F.when(F.col("_used.failed"), S.PROVIDER_ERROR).otherwise(S.COMPLETED).alias("terminal_state"),
        "retried",
    )
