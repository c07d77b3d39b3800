"""Server-sent-event lines: recognise, decode, never fail."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters a Unicode whitespace trim removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Line prefix, end marker and chunk layout.
PREFIX = "data:"
DONE = "[DONE]"
CHUNK = (
    "choices array<struct<delta: struct<content: string>>>, "
    "usage struct<prompt_tokens: bigint, completion_tokens: bigint>"
)


def payload(line: Column) -> Column:
    """What follows ``data:``, trimmed; NULL for any other line."""
    bare = F.trim(line, F.lit(WHITESPACE))
    return F.when(
        bare.startswith(PREFIX), F.trim(F.substr(bare, F.lit(len(PREFIX) + 1)), F.lit(WHITESPACE))
    )


def is_done(body: Column) -> Column:
    return F.coalesce(body == DONE, F.lit(False))


def chunk(body: Column) -> Column:
    """The decoded chunk. Broken JSON and JSON of another shape give NULL fields."""
    return F.from_json(F.when(body != DONE, body), CHUNK)


def content_length(decoded: Column) -> Column:
    """Code points of all delta contents of one chunk; no text is built."""
    return F.coalesce(
        F.aggregate(
            decoded["choices"],
            F.lit(0).cast("bigint"),
            lambda total, choice: total
            + F.coalesce(F.length(choice["delta"]["content"]), F.lit(0)).cast("bigint"),
        ),
        F.lit(0).cast("bigint"),
    )


def content_text(decoded: Column) -> Column:
    return F.array_join(
        F.transform(decoded["choices"], lambda choice: choice["delta"]["content"]), ""
    )
