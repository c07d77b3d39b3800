"""The queries of this package, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallybook.llm import (
    centroids, debruijn, language, lines, mixing, nearest, packing, quality, simhash, suffixes, topk, urls,
    whitening,
)
from tallybook.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# The rules of the url query: host, path, verdict.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_quality_votes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = fold(F.col("doc_id"), 3, 1)
    labels = table(spark, folder, "labels").where(~held_out)
    scored = quality.predict(docs, quality.fit(docs, labels, "quality"))
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = suffixes.remove_repeats(table(spark, folder, "documents"))
    removed = F.aggregate(
        "spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["first"]
    )
    return left.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op3_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken_words(table(spark, folder, "documents"))


@query
def op4_language_filters(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4, 2)
    model = language.learn(docs.where(~held_out))
    judged = language.predict(docs.drop("lang"), model, ["doc_id"])
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urls.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE["op5_url_filters"] = f"""
WITH rules(rh, rp, rv) AS (VALUES {", ".join(map(str, URL_RULES))}),
parts AS (
  SELECT page_id, row_number() OVER () AS n,
    coalesce(translate(regexp_extract(url, '^(?s:.)*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.)*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
),
fits AS (
  SELECT n, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
  FROM parts JOIN rules
    ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM parts LEFT JOIN fits USING (n)
"""


@query
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return packing.pack_documents(docs, tokenizer_path())


@query
def op7_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


ORACLE["op8_line_dedup"] = r"""
WITH every AS (
  SELECT doc_id, i, lines[i] AS line,
    translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
),
frequent AS (
  SELECT key FROM every WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM every LEFT JOIN frequent f USING (key) GROUP BY doc_id
"""


def is_query() -> Column:
    return F.col("vec_id") % 50 == 0


@query
def op9_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.exact_top_k(table(spark, folder, "embeddings"), is_query())


ORACLE["op9_exact_top_k"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""


@query
def op10_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest(table(spark, folder, "embeddings"), is_query())


@query
def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = debruijn.remove_earlier(table(spark, folder, "documents"))
    removed = F.aggregate(
        "spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["first"]
    )
    return left.select(
        "doc_id",
        "n_words",
        removed.alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


@query
def op13_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    found = centroids.cluster(table(spark, folder, "embeddings"))
    text = F.array_join(F.transform("centroid", lambda c: c.cast("string")), ",")
    every = found.centres.groupBy().agg(F.sum("inertia").alias("inertia"))
    centres = found.centres.select(
        "cluster", F.col("inertia").alias("cluster_inertia"), F.sha2(text, 256).alias("centroid_sha256")
    ).crossJoin(F.broadcast(every))
    return found.rows.join(F.broadcast(centres), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def clusters_sql(rounds: int = 3) -> str:
    """The clustering, one block of statements a round."""
    parts = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id,
    list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        """c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS cluster, v AS c
  FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept) ORDER BY cluster LIMIT 16
)""",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (
  SELECT n, vec_id, v, cluster, d FROM (
    SELECT n, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c),
      lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM kept, c{r}
  ) QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, cluster) = 1
)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (
  SELECT cluster, list((s - ((s % m) + m) % m) // m ORDER BY i) AS c FROM (
    SELECT cluster, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS m
    FROM a{r}, range(1, 65) AS places(i) GROUP BY cluster, i
  ) GROUP BY cluster
  UNION ALL SELECT cluster, c FROM c{r} WHERE cluster NOT IN (SELECT cluster FROM a{r})
)"""
            )
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
  CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


ORACLE["op13_centroid_clusters"] = clusters_sql()
