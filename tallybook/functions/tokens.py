"""Token counts, request defaults and clock conversions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

from tallybook import schemas as S

CHARS_PER_TOKEN = 4
ADMISSION_DEFAULT = 512


def tokens_for_length(length: Column) -> Column:
    """0 for nothing, otherwise a quarter of the code points and at least 1."""
    whole = (length / F.lit(CHARS_PER_TOKEN)).cast("bigint")
    return F.when(length > 0, F.greatest(F.lit(1).cast("bigint"), whole)).otherwise(
        F.lit(0).cast("bigint")
    )


def token_estimate(text: Column) -> Column:
    return tokens_for_length(F.coalesce(F.length(text), F.lit(0)).cast("bigint"))


def content_texts(content: Column) -> Column:
    """The texts of one message content: the string itself, or the text of each part."""
    of_parts = F.transform(
        F.try_variant_get(content, "$", "array<variant>"),
        lambda part: F.when(
            F.schema_of_variant(part).startswith("OBJECT"),
            F.try_variant_get(part, "$.text", "string"),
        ),
    )
    of_string = F.when(
        F.schema_of_variant(content) == "STRING",
        F.array(F.try_variant_get(content, "$", "string")),
    )
    return F.coalesce(of_parts, of_string, F.array().cast("array<string>"))


def content_tokens(content: Column) -> Column:
    """Tokens of one message content held as a variant: a string, or a list of parts.

    The list is tried first, because asking an array for ``string`` yields its JSON text.
    """
    parts = F.try_variant_get(content, "$", "array<variant>")
    of_parts = F.aggregate(
        parts,
        F.lit(0).cast("bigint"),
        lambda total, part: total
        + token_estimate(
            F.when(
                F.schema_of_variant(part).startswith("OBJECT"),
                F.try_variant_get(part, "$.text", "string"),
            )
        ),
    )
    of_string = F.when(
        F.schema_of_variant(content) == "STRING",
        token_estimate(F.try_variant_get(content, "$", "string")),
    )
    return F.coalesce(of_parts, of_string, F.lit(0).cast("bigint"))


def prompt_tokens(body: Column) -> Column:
    """Prompt tokens of a chat request body (JSON text), message by message."""
    messages = F.from_json(body, "messages array<struct<content: variant>>")["messages"]
    return F.coalesce(
        F.aggregate(
            messages,
            F.lit(0).cast("bigint"),
            lambda total, m: total + content_tokens(m["content"]),
        ),
        F.lit(0).cast("bigint"),
    )


def prompt_texts(body: Column) -> Column:
    """All texts of a chat request body (JSON text), for a tokenizer to count one by one."""
    messages = F.from_json(body, "messages array<struct<content: variant>>")["messages"]
    texts = F.flatten(F.transform(messages, lambda m: content_texts(m["content"])))
    return F.coalesce(texts, F.array().cast("array<string>"))


def admission_estimate(
    prompt: Column, max_tokens: Column, default: int = ADMISSION_DEFAULT
) -> Column:
    """Prompt plus the declared completion size; an absent or zero size means the default."""
    return prompt + F.coalesce(F.nullif(max_tokens, F.lit(0)), F.lit(default)).cast("bigint")


def request_defaults(
    request_id: Column, idempotency_key: Column, tenant_id: Column, model: Column
) -> dict[str, Column]:
    return {
        "idempotency_key": F.coalesce(
            F.nullif(idempotency_key, F.lit("")), F.concat(F.lit("auto-"), request_id)
        ),
        "tenant_id": F.coalesce(tenant_id, F.lit(S.DEFAULT_TENANT)),
        "model": F.coalesce(model, F.lit(S.UNKNOWN_MODEL)),
    }


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint"))


def to_epoch(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp")) / F.lit(1e6)


def text_counter(counter: Callable[[str], int]):
    """A vectorised column function around any ``str -> int`` tokenizer.

    Use it only where the count must be exact: text leaves the JVM in Arrow batches.
    """
    def count(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda text: counter(text) if text else 0).astype("int64")

    return F.pandas_udf(count, "bigint")


CounterFor = Callable[[str], Callable[[str], int] | None]


def model_counter(counter_for: CounterFor):
    """A vectorised function of (texts array, model) giving ``tokens`` and ``exact``.

    ``counter_for`` names the tokenizer of a model, or None where it has none: then its lengths are
    estimated and the count is not exact. Texts are counted one by one and added up.
    """

    def estimate(text: str) -> int:
        return max(1, len(text) // CHARS_PER_TOKEN)

    def count(texts: pd.Series, models: pd.Series) -> pd.DataFrame:
        known = {m: counter_for(m) for m in models.unique()}
        rows = [
            (sum((known[m] or estimate)(t) for t in some if t) if some is not None else 0, known[m] is not None)
            for some, m in zip(texts, models, strict=True)
        ]
        return pd.DataFrame(rows, columns=["tokens", "exact"])

    counted = F.pandas_udf(count, "tokens bigint, exact boolean")
    return lambda texts, model: counted(texts, F.coalesce(model, F.lit(S.UNKNOWN_MODEL)))
