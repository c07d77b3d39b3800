"""The three feeds kept bucketed by request, so that repeated reconciliations move nothing.

A delivery is hashed by request once, when it is appended, and its rows lie in the bucket of their request.
Spark then knows that a request is in one bucket and aggregates bucket by bucket, without an
exchange, however often the ledger is reconciled and however many deliveries were appended.

A bucket is one task, so requests with very many copies do not belong there: what a sketch finds
heavy in a delivery goes to a plain folder beside the buckets. Of the few requests found there, all rows,
those in the buckets included, are combined before a shuffle as usual. Every row is kept in
exactly one of the two places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallybook import schemas as S
from tallybook.operators import reconcile as rec
from tallybook.operators.skew import heavy_keys, key_hash
from tallybook.session import staged

HEAVY_COPIES = 100_000


def _stored_schema() -> T.StructType:
    fields = {f.name: f for s in (S.METERED_SCHEMA, S.STARTED_SCHEMA) for f in s.fields}
    times = [f for f in S.METERED_SCHEMA.fields if f.name == "ended_at"]
    kept = ["request_id", "prompt_tokens", "completion_tokens", "terminal_state", "model", "tenant_id"]
    return T.StructType(
        [
            T.StructField("side", T.StringType()),
            T.StructField("at", times[0].dataType),
            *[T.StructField(n, fields[n].dataType) for n in [*kept, "idempotency_key"]],
        ]
    )


@dataclass
class FeedStore:
    """Feeds in ``path``, known to the session as table ``name``; ``buckets`` never changes.

    Size buckets for the whole ledger: a bucket's rows are one task of every reconciliation.
    """

    spark: SparkSession
    path: str
    name: str
    buckets: int = 1024
    heavy_copies: int = HEAVY_COPIES

    def __post_init__(self):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _stored_schema())
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{self.name}` ({columns}) USING parquet "
            f"CLUSTERED BY (request_id) SORTED BY (request_id) INTO {self.buckets} BUCKETS "
            f"LOCATION '{self.path}/buckets'"
        )
        # an empty write, so that the folder of heavy requests can always be read
        empty = self.spark.createDataFrame([], _stored_schema())
        empty.write.mode("append").parquet(f"{self.path}/heavy")

    def append(self, started: DataFrame, metered: DataFrame, usage: DataFrame) -> None:
        """Add a delivery. It is written before it is dealt, so that both places see the same rows."""
        names = _stored_schema().names
        rows = staged(rec.tagged(started, metered, usage, keyed=True).select(*names), "delivery")
        heavy = staged(heavy_keys(rows, ["request_id"], at_least=self.heavy_copies), "heavy-requests")
        marked = rows.withColumn("_heavy", key_hash(["request_id"]))
        many = marked.join(F.broadcast(heavy), "_heavy").select(*names)
        few = marked.join(F.broadcast(heavy), "_heavy", "left_anti").select(*names)
        many.write.mode("append").parquet(f"{self.path}/heavy")
        # one file to a bucket and delivery: the same hash deals rows to tasks and to buckets
        (
            few.repartition(self.buckets, "request_id")
            .write.bucketBy(self.buckets, "request_id")
            .sortBy("request_id")
            .format("parquet")
            .option("path", f"{self.path}/buckets")
            .mode("append")
            .saveAsTable(self.name)
        )

    def _parts(self) -> list[DataFrame]:
        heavy = self.spark.read.schema(_stored_schema()).parquet(f"{self.path}/heavy")
        total = F.col("prompt_tokens") + F.col("completion_tokens")
        us = rec.micros(F.col("at"))
        return [
            part.withColumns({"total": total, "us": us})
            for part in (self.spark.table(self.name), heavy)
        ]

    def feed(self) -> DataFrame:
        """All rows, as ``tagged`` gives them."""
        light, heavy = self._parts()
        return light.unionByName(heavy)

    def reconciliation(self, *, as_of=None, **options) -> rec.Reconciled:
        """What ``reconcile.reconciliation`` gives for all deliveries together."""
        light, heavy = self._parts()
        known = heavy.select("request_id").distinct()
        busy = not heavy.isEmpty()

        def states(_: DataFrame) -> DataFrame:
            parts = [light, heavy]
            if as_of is not None:
                parts = [part.where(F.col("at") <= as_of) for part in parts]
            if not busy:
                return rec.request_state(parts[0])
            # the size of the list of requests decides how it is joined; the buckets stay where they are
            apart = rec.request_state(parts[0].join(known, "request_id", "left_anti"))
            there = parts[0].join(known, "request_id", "left_semi").select(*parts[1].columns)
            return apart.unionByName(rec.request_state(parts[1].unionByName(there)))

        return rec.reconcile_feed(self.feed(), states=states, as_of=as_of, **options)
