"""Retrieval over stand-ins: documents for fragments, benchmark for gold queries, embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import is_unit
from ..operators import evidence, ranking, retrieval
from ..sources.tables import table
from .registered import query

_FOLD_Q = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
_TOKENS = "list_filter(regexp_extract_all(lower(coalesce({}, '')), '[A-Za-zА-Яа-яЁё0-9]+'), lambda t: length(t) >= 3 OR regexp_full_match(t, '[0-9]+'))"


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.exact_hits(_queries(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", "text")


_EXACT_SQL = f"SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains({_FOLD_Q.format('d.text')}, {_FOLD_Q.format('b.text')})"
_TOKEN_SQL = f"""
  SELECT q.query_id, p.doc_id, count(*) AS n_shared, sum(p.tf) AS tf, count(*) / any_value(q.n_terms) AS coverage
  FROM (SELECT query_id, len(terms) AS n_terms, unnest(terms) AS term FROM (SELECT item_id AS query_id, list_distinct({_TOKENS.format('text')}) AS terms FROM benchmark)) q
  JOIN (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY 1, 2) p ON p.term = q.term
  GROUP BY 1, 2
"""
_TOP_SQL = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, tf DESC, doc_id) AS rank FROM ({_TOKEN_SQL})"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _queries(spark, sf_dir)
    return retrieval.token_scores(asked, retrieval.postings(table(spark, sf_dir, "documents"), "doc_id", "text", retrieval.query_terms(asked)))


def _top_tokens(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    scored = _scores(spark, sf_dir)
    return ranking.best_per_query(scored, "query_id", [F.desc("coverage"), F.desc("tf"), F.col("doc_id")], k)


@query(f"SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM ({_EXACT_SQL})) WHERE rank <= 10")
def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_per_query(_exact(spark, sf_dir), "query_id", [F.col("doc_id")], 10)


@query("""
SELECT doc_id, CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'password') AS INT) + CAST(contains(lower(text), '@mail') AS INT) + 0.0 AS exact_score
FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'password') OR contains(lower(text), '@mail')
""")
def exact_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of some codes each text contains, whatever the case; those with none leave."""
    score = retrieval.exact_score(F.col("text"), ["License", "password", "@mail"])
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("exact_score")).where("exact_score > 0")


@query(f"SELECT query_id, doc_id, n_shared, CAST(tf AS BIGINT) AS tf, round(coverage, 6) AS coverage, rank FROM ({_TOP_SQL}) WHERE rank <= 10")
def token_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_tokens(spark, sf_dir).select("query_id", "doc_id", "n_shared", "tf", F.round("coverage", 6).alias("coverage"), "rank")


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 is a query, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.dense_topk(asked, vectors, 10)


_DENSE_SQL = """
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 5) AS similarity
    FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
"""


@query(f"SELECT query_id, vec_id, similarity, rank FROM ({_DENSE_SQL}) WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact scan in blocks."""
    return _dense(spark, sf_dir).select("query_id", "vec_id", "similarity", "rank")


@query("""
SELECT label, count(*) AS n, count(*) FILTER (WHERE abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) - 1) <= 0.02) AS n_unit
FROM embeddings GROUP BY 1
""")
def vector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", is_unit(F.col("embedding")).alias("unit"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if("unit").alias("n_unit"))


@query(f"""
WITH channels AS (
  SELECT query_id, 'fts' AS channel, doc_id AS item_id, rank FROM ({_TOP_SQL}) WHERE rank <= 10
  UNION ALL SELECT query_id, 'dense', vec_id, rank FROM ({_DENSE_SQL}) WHERE rank <= 10
), fused AS (SELECT query_id, item_id, sum(1.0 / (60 + rank)) AS rrf, count(*) AS n_channels FROM channels GROUP BY 1, 2)
SELECT query_id, item_id, round(rrf, 8) AS rrf, n_channels, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 8) DESC, item_id) AS rank FROM fused) WHERE rank <= 10
""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fts = _top_tokens(spark, sf_dir).select("query_id", F.lit("fts").alias("channel"), F.col("doc_id").alias("item_id"), "rank")
    dense = _dense(spark, sf_dir).select("query_id", F.lit("dense").alias("channel"), F.col("vec_id").alias("item_id"), "rank")
    fused = ranking.fuse(fts.unionByName(dense)).withColumn("rrf", F.round("rrf", 8))
    return ranking.best_per_query(fused, "query_id", [F.desc("rrf"), F.col("item_id")], 10)


@query(f"""
WITH hits AS (SELECT query_id, doc_id, rank FROM ({_TOP_SQL}) WHERE rank <= 10), first AS (
  SELECT e.query_id, min(h.rank) AS rank FROM ({_EXACT_SQL}) e LEFT JOIN hits h ON h.query_id = e.query_id AND h.doc_id = e.doc_id GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_10,
       round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0.0 END), 6) AS mrr FROM first
""")
def retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage are expected; the token channel is judged."""
    expected = _exact(spark, sf_dir).withColumnRenamed("doc_id", "item_id")
    hits = _top_tokens(spark, sf_dir).select("query_id", F.col("doc_id").alias("item_id"), "rank")
    found = ranking.evaluate_ranks(expected, hits)
    return found.select("n_queries", *[F.round(c, 6).alias(c) for c in ("recall_at_5", "recall_at_10", "mrr")])


@query("""
WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, any_value(n) AS n_values, round_even(max(value) FILTER (WHERE i = round_even(0.5 * (n - 1), 0)), 3) AS p50, round_even(max(value) FILTER (WHERE i = round_even(0.95 * (n - 1), 0)), 3) AS p95,
       round((SELECT avg(e.value) FROM events e WHERE e.event_type = o.event_type), 6) AS mean
FROM o GROUP BY event_type
""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    means = rows.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return ranking.nearest_rank(rows, ["event_type"], "value", (50, 95)).join(means, "event_type")


@query(f"""
WITH shared AS (SELECT doc_id, max(n_shared) AS n_shared, count(*) AS n FROM ({_TOKEN_SQL}) GROUP BY 1), exact AS (SELECT DISTINCT doc_id FROM ({_EXACT_SQL})), c AS (
  SELECT d.lang AS theme, CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'HUMAN_ACTION_LIKELY' WHEN coalesce(s.n, 0) = 0 THEN 'NO_EVIDENCE' WHEN coalesce(s.n_shared, 0) = 0 THEN 'UNASSESSABLE' WHEN e.doc_id IS NOT NULL THEN 'EVIDENCE_POSSIBLE' ELSE 'UNASSESSABLE' END AS class
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN shared s ON s.doc_id = d.doc_id LEFT JOIN exact e ON e.doc_id = d.doc_id)
SELECT theme, count(*) AS n, count(*) FILTER (WHERE class = 'HUMAN_ACTION_LIKELY') AS human_action_likely, count(*) FILTER (WHERE class = 'NO_EVIDENCE') AS no_evidence,
       count(*) FILTER (WHERE class = 'UNASSESSABLE') AS unassessable, count(*) FILTER (WHERE class = 'EVIDENCE_POSSIBLE') AS evidence_possible FROM c GROUP BY 1
""")
def coverage_by_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = _scores(spark, sf_dir)
    shared = scored.groupBy("doc_id").agg(F.max("n_shared").alias("n_shared"), F.count("*").alias("n"))
    exact = _exact(spark, sf_dir).select("doc_id").distinct().withColumn("exact", F.lit(True))
    rows = docs.select("doc_id", F.col("lang").alias("theme")).join(labels, "doc_id", "left").join(shared, "doc_id", "left").join(exact, "doc_id", "left")
    zero = F.lit(0)
    kind = evidence.coverage_class(F.coalesce("toxic", zero) == 1, F.coalesce("n", zero), F.coalesce("n_shared", zero), F.col("exact").isNotNull())
    counts = [F.count_if(F.col("class") == c).alias(c.lower()) for c in evidence.CLASSES]
    return rows.withColumn("class", kind).groupBy("theme").agg(F.count("*").alias("n"), *counts)


_FOLDED = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query(f"""
WITH u AS (SELECT sha256({_FOLDED}) AS identity, lang AS theme, min(doc_id) AS doc_id FROM documents WHERE {_FOLDED} <> '' GROUP BY 1, 2),
once AS (SELECT identity, arg_min(theme, doc_id) AS theme, min(doc_id) AS doc_id FROM u GROUP BY 1),
sizes AS (SELECT theme, count(*) AS n FROM once GROUP BY 1), total AS (SELECT least(60, sum(n)) AS target, sum(sqrt(n)) AS w, count(*) AS g FROM sizes),
shared AS (SELECT theme, n, 1 + least(n - 1, CAST(floor((target - g) * sqrt(n) / w) AS BIGINT)) AS taken FROM sizes, total),
ordered AS (SELECT *, row_number() OVER (ORDER BY n - taken DESC, theme) AS k, (SELECT target FROM total) - (SELECT sum(taken) FROM shared) AS missing FROM shared),
quota AS (SELECT theme, taken + CASE WHEN k = 1 THEN missing ELSE 0 END AS quota FROM ordered)
SELECT doc_id, o.theme FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY sha256('20260912|' || identity || '|' || doc_id)) AS place FROM once) o JOIN quota q ON q.theme = o.theme WHERE place <= quota
""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty distinct texts with every language: the sampling operator's own limit."""
    folded = F.lower(T.fold_spaces(F.col("text")))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(folded != "", F.sha2(folded, 256)).alias("identity"))
    picked = ranking.stratified_sample(rows, F.col("identity"), F.col("lang"), F.col("doc_id"), 60)
    return picked.select("doc_id", F.col("lang").alias("theme"))
