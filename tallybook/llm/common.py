"""Small helpers the operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallybook.session import shared_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(rows: DataFrame, label: str, *partition: str) -> DataFrame:
    """Write rows once to the shared folder and read them back; later steps start from files.

    A lost executor then costs a read, and costly Python above is not run again.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    rows.write.partitionBy(*partition).parquet(path)
    kept = [f for f in rows.schema.fields if f.name not in partition]
    last = [f for f in rows.schema.fields if f.name in partition]
    schema = type(rows.schema)(kept + last)
    return spark.read.schema(schema).parquet(path)


def packed(rows: DataFrame) -> DataFrame:
    """All columns in one struct ``_row``, so that no name of theirs can clash with a new one."""
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(value: Column, modulus: int, remainder: int) -> Column:
    """True for rows of a fold by crc32 of the id as text. A null id is in no fold."""
    same = F.crc32(value.cast("string")) % modulus == remainder
    return F.coalesce(same, F.lit(False))


def text_hash(text: Column) -> Column:
    """With doc_id, tells rows apart; repeated rows share it and share their result."""
    return F.xxhash64(F.lit(11), text)


def uniform(*parts: Column) -> Column:
    """A repeatable number in [0, 1) from the given parts."""
    return (F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
