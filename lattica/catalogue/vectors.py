"""Vector search, parity, overlap, sampling and text links over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import resolve, vectors
from lattica.plans.templates import record_id
from lattica.session import table


def base(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vectors.check_dim(F.col("embedding"), 64).alias("vec"), "label")


def coarse(spark, sf_dir):
    """The index again with its numbers rounded to one place, as a second index to compare with."""
    return base(spark, sf_dir).select("id", F.transform("vec", lambda x: F.round(x.cast("double"), 1)).alias("vec"))


def queries(spark, sf_dir):
    return base(spark, sf_dir).where("id % 100 = 0")


def _out(rows):
    return rows.select("q", "id", F.round("score", 6).alias("score"), "rank")


def vector_topk(spark, sf_dir):
    return _out(vectors.top_k(queries(spark, sf_dir), base(spark, sf_dir), 10))


def vector_neighbors(spark, sf_dir):
    return _out(vectors.top_k(queries(spark, sf_dir), base(spark, sf_dir), 10, skip_self=True))


def pair_parity(spark, sf_dir):
    out = vectors.parity(base(spark, sf_dir), coarse(spark, sf_dir))
    return out.select("n", F.round("mean_cosine", 6).alias("mean_cosine"), F.round("min_cosine", 6).alias("min_cosine"), "missing", "ok")


def topk_overlap(spark, sf_dir):
    q = queries(spark, sf_dir)
    shared = vectors.overlap(vectors.top_k(q, base(spark, sf_dir), 10), vectors.top_k(q, coarse(spark, sf_dir), 10))
    return shared.agg(F.count("*").alias("n"), F.round(F.avg("n"), 6).alias("mean_overlap"), F.min("n").alias("min_overlap"))


def point_sample(spark, sf_dir):
    return vectors.sample(base(spark, sf_dir), 50, seed=5).select("id", F.col("label").cast("long").alias("label"))


def text_link_candidates(spark, sf_dir):
    """Neighbours whose title the query's document mentions and that no edge links; a title is a document's first long word."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower(F.regexp_extract("text", "([A-Za-z]{4,})", 1)).alias("title"), "text")
    links = base(spark, sf_dir).select(F.least("id", F.col("id") * 7 % 500).alias("lo"), F.greatest("id", F.col("id") * 7 % 500).alias("hi")).distinct()
    found = resolve.text_links(vectors.top_k(queries(spark, sf_dir), base(spark, sf_dir), 50, skip_self=True), docs, links)
    ids = found.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"].cast("string")), ",").alias("answers"), F.count("*").alias("n"))
    sorted_ids = F.array_join(F.array_sort(F.split("answers", ",")), "|")
    return ids.select(record_id("sim", [F.col("q").cast("string"), sorted_ids]).alias("id"), "q", "answers", "n")


_SIM = """
v AS (SELECT vec_id AS id, [CAST(x AS DOUBLE) FOR x IN embedding] AS a, [round(CAST(x AS DOUBLE), 1) FOR x IN embedding] AS c FROM embeddings),
s AS (SELECT q.vec_id AS q, v.id, list_inner_product([CAST(x AS DOUBLE) FOR x IN q.embedding], v.a) / sqrt(list_inner_product([CAST(x AS DOUBLE) FOR x IN q.embedding], [CAST(x AS DOUBLE) FOR x IN q.embedding]) * list_inner_product(v.a, v.a)) AS score,
  list_inner_product([CAST(x AS DOUBLE) FOR x IN q.embedding], v.c) / sqrt(list_inner_product([CAST(x AS DOUBLE) FOR x IN q.embedding], [CAST(x AS DOUBLE) FOR x IN q.embedding]) * list_inner_product(v.c, v.c)) AS score2 FROM embeddings q, v WHERE q.vec_id % 100 = 0)"""


def _top_sql(where: str) -> str:
    return f"WITH {_SIM}, r AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS rank FROM s WHERE {where}) SELECT q, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10"


QUERIES = {
    "vector_topk": vector_topk,
    "vector_neighbors_excl_self": vector_neighbors,
    "vector_pair_parity": pair_parity,
    "topk_overlap": topk_overlap,
    "vector_point_sample": point_sample,
    "text_link_candidates": text_link_candidates,
}
ORACLES = {
    "vector_topk": _top_sql("true"),
    "vector_neighbors_excl_self": _top_sql("q <> id"),
    "vector_pair_parity": f"WITH {_SIM}, p AS (SELECT list_inner_product(a, c) / sqrt(list_inner_product(a, a) * list_inner_product(c, c)) AS x FROM v) SELECT count(*) AS n, round(avg(x), 6) AS mean_cosine, round(min(x), 6) AS min_cosine, CAST(0 AS BIGINT) AS missing, min(x) >= 0.98 AS ok FROM p",
    "topk_overlap": f"""
WITH {_SIM}, a AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS k FROM s), b AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY round(score2, 9) DESC, id) AS k FROM s),
o AS (SELECT a.q, count(b.id) AS n FROM a LEFT JOIN b ON a.q = b.q AND a.id = b.id AND b.k <= 10 WHERE a.k <= 10 GROUP BY a.q)
SELECT count(*) AS n, round(avg(n), 6) AS mean_overlap, min(n) AS min_overlap FROM o""",
    "vector_point_sample": "SELECT vec_id AS id, CAST(label AS BIGINT) AS label FROM embeddings ORDER BY sha256('5|' || vec_id), vec_id LIMIT 50",
    "text_link_candidates": f"""
WITH {_SIM}, r AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS rank FROM s WHERE q <> id),
d AS (SELECT doc_id AS id, lower(regexp_extract(text, '([A-Za-z]{{4,}})', 1)) AS title, lower(text) AS text FROM documents),
l AS (SELECT DISTINCT least(vec_id, vec_id * 7 % 500) AS lo, greatest(vec_id, vec_id * 7 % 500) AS hi FROM embeddings),
m AS (SELECT r.q, r.id, r.rank FROM r JOIN d n ON n.id = r.id JOIN d x ON x.id = r.q WHERE rank <= 50 AND length(n.title) >= 4
  AND regexp_matches(x.text, '(^|[^\\pL\\pN_])' || n.title || '($|[^\\pL\\pN_])') AND NOT EXISTS (SELECT 1 FROM l WHERE lo = least(r.q, r.id) AND hi = greatest(r.q, r.id))),
k AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY rank, id) AS n FROM m), g AS (
SELECT q, string_agg(CAST(id AS VARCHAR), ',' ORDER BY n) AS answers, string_agg(CAST(id AS VARCHAR), '|' ORDER BY CAST(id AS VARCHAR)) AS sorted, count(*) AS n FROM k WHERE n <= 10 GROUP BY q)
SELECT 'sim-' || left(sha1(q || '|' || sorted), 12) AS id, q, answers, n FROM g""",
}
