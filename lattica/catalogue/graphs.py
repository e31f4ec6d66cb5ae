"""Golden sets, anchors, degrees, cards, neighbours and paths over the derived graph."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.ids import seeded
from lattica.operators import graph
from lattica.plans import triples as T
from lattica.plans.templates import MAX_ANSWERS, TEMPLATES, anchor_pool, golden, golden_sql

NAMES = {
    "golden_chain_2hop_film_school": "chain_film_director_school",
    "golden_chain_2hop_work_org": "chain_work_author_org",
    "golden_chain_2hop_person_founder": "chain_person_company_founder",
    "golden_star_school_occupation": "star_school_occupation",
    "golden_star_costars": "star_costars",
    "golden_star_director_cast": "star_director_cast",
    "golden_intersection_founder_school_owner": "intersection_founder_school_owner",
    "golden_intersection_member_school_country": "intersection_org_member_school_country",
    "golden_chain_3hop_employee": "chain_employee_founder_school",
    "golden_chain_4hop_same_school": "chain_same_school_directors",
    "golden_chain_4hop_subsidiary": "chain_employee_subsidiary_founder_school",
}
HUB = "Q2000000003"
PAIRS = [("Q3000000001", "Q3000000002"), ("Q3000000001", "Q2000000019"), ("Q3000000006", "Q4000000000"), ("Q1000000000", "Q1000000001"), ("Q3000000012", "Q8000000013"), ("Q4000000003", "Q4000000027")]


def edges_of(spark: SparkSession, sf_dir: str):
    read = T.reader(spark, sf_dir)
    return lambda rel: T.edges(spark, sf_dir, rel, read)


def flat(df: DataFrame, *columns: str) -> DataFrame:
    """Array columns as comma-separated text."""
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


def golden_of(name: str, spark: SparkSession, sf_dir: str, max_answers: int | None = MAX_ANSWERS) -> DataFrame:
    return flat(golden(TEMPLATES[name], edges_of(spark, sf_dir), max_answers), "answers", "bridges")


def uncapped(sql: str) -> str:
    """The SQL of golden sets of any size."""
    return sql.replace(f" HAVING count(*) <= {MAX_ANSWERS}", "")


def anchor_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of each template, how many there are, and the one that a seeded order puts first."""
    parts, edges = [], edges_of(spark, sf_dir)
    for t in TEMPLATES.values():
        key = F.concat_ws("|", *t.anchors)
        pool = anchor_pool(t, edges).select(key.alias("k"))
        parts.append(pool.agg(F.lit(t.name).alias("template"), F.count("*").alias("n_anchors"), F.min_by("k", F.concat(seeded(7, F.col("k")), "k")).alias("pick")))
    return reduce(DataFrame.union, parts)


def _anchor_sql() -> str:
    parts = []
    for t in TEMPLATES.values():
        at: dict[str, str] = {}
        where = []
        for i, (a, rel, b) in enumerate(t.edges):
            where.append(f"t{i}.rel = '{rel}'")
            for var, col in ((a, f"t{i}.src"), (b, f"t{i}.dst")):
                if var in at:
                    where.append(f"{at[var]} = {col}")
                else:
                    at[var] = col
        where += [f"{at[a]} {op} {at[b]}" for a, op, b in t.guards + t.sampler_guards]
        key = " || '|' || ".join(at[a] for a in t.anchors)
        parts.append(f"SELECT '{t.name}' AS template, count(*) AS n_anchors, arg_min(k, sha256('7|' || k) || k) AS pick FROM (SELECT DISTINCT {key} AS k FROM {', '.join(f'triple t{i}' for i in range(len(t.edges)))} WHERE {' AND '.join(where)})")
    return f"WITH {T.TRIPLE_CTE} " + " UNION ALL ".join(parts)


def entity_degrees(spark, sf_dir):
    return graph.degrees(T.triples(spark, sf_dir))


def get_entity_card(spark, sf_dir):
    rows = graph.cards(T.entities(spark, sf_dir), T.aliases(spark, sf_dir), T.triples(spark, sf_dir))
    return flat(rows, "aliases").withColumn("abstract", F.sha2(F.coalesce("abstract", F.lit("")), 256))


def page(spark, sf_dir, **args):
    return graph.neighbors(T.triples(spark, sf_dir), T.titles(spark, sf_dir), T.relation_labels(spark), HUB, **args)


def _page_sql(where: str, limit: int = 25, offset: int = 0) -> str:
    return f"""
WITH {T.TRIPLE_CTE}, {T.ENTITY_CTE}, {T.RELATION_CTE}, f AS (SELECT * FROM triple WHERE {where}),
p AS (SELECT * FROM f ORDER BY rel, dst, src LIMIT {limit} OFFSET {offset})
SELECT (SELECT count(*) FROM f) AS total, p.src, p.rel, coalesce(r.label, p.rel) AS rel_label, p.dst, coalesce(e.title, p.dst) AS dst_title
FROM p LEFT JOIN relation r ON r.pid = p.rel LEFT JOIN entity e ON e.qid = p.dst"""


def shortest_paths_pairs(spark, sf_dir):
    return graph.shortest_paths(T.triples(spark, sf_dir), spark.createDataFrame(PAIRS, "s string, t string"), 3, 20)


def shortest_paths_titled(spark, sf_dir):
    """The same paths with titled nodes and labelled edges, as text."""
    rows = graph.path_parts(shortest_paths_pairs(spark, sf_dir), T.titles(spark, sf_dir), T.relation_labels(spark))
    edges = F.transform("edges", lambda e: F.concat_ws(" ", e["src"], e["rel"], e["rel_label"], e["dst"]))
    return rows.select("s", "t", "length", F.array_join("nodes.qid", ",").alias("ids"), F.array_join("nodes.title", "|").alias("titles"), F.array_join(edges, "|").alias("edges"))


def _paths_sql() -> str:
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in PAIRS)
    hop = "SELECT src AS u, '-' || rel || '>' AS lab, dst AS v FROM triple UNION ALL SELECT dst, '<' || rel || '-', src FROM triple WHERE src <> dst"
    return f"""
WITH RECURSIVE {T.TRIPLE_CTE}, step AS ({hop}), pair(s, t) AS (VALUES {pairs}), walk AS (
  SELECT s, t, s AS node, s AS path, 0 AS n FROM pair
  UNION ALL SELECT w.s, w.t, st.v, w.path || st.lab || st.v, w.n + 1 FROM walk w JOIN step st ON st.u = w.node WHERE w.n < 3 AND w.node <> w.t
), hit AS (SELECT s, t, n, path FROM walk WHERE node = t AND n > 0), best AS (SELECT s, t, min(n) AS n FROM hit GROUP BY s, t),
ranked AS (SELECT h.s, h.t, h.n, h.path, row_number() OVER (PARTITION BY h.s, h.t ORDER BY h.path) AS k FROM hit h JOIN best b ON h.s = b.s AND h.t = b.t AND h.n = b.n)
SELECT s, t, CAST(n AS BIGINT) AS length, path FROM ranked WHERE k <= 20"""


def node_union_missing_titles(spark, sf_dir):
    return graph.node_set(T.entities(spark, sf_dir), T.triples(spark, sf_dir))


def triple_label_join(spark, sf_dir):
    labels = T.relation_labels(spark).where("pid <> 'P127'")
    return graph.label_edges(T.triples(spark, sf_dir), labels).groupBy("rel", "rel_label").agg(F.count("*").alias("n"), F.min("src").alias("first_src"))


def hop_pick(spark, sf_dir):
    anchors = T.edges(spark, sf_dir, "P69").select(F.col("src").alias("qid")).distinct()
    return graph.hop(T.triples(spark, sf_dir), anchors, seed=3)


def edge_pairs(spark, sf_dir):
    """Pairs of customers and suppliers by key that an edge links, in any direction."""
    linked = graph.linked_pairs(T.triples(spark, sf_dir))
    c = T.table(spark, sf_dir, "customer").select(T.qid(T.CUSTOMER, F.col("c_custkey")).alias("a"), T.qid(T.SUPPLIER, F.expr("c_custkey div 6")).alias("b"))
    keyed = c.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    yes = keyed.join(linked, ["lo", "hi"], "left_semi").agg(F.lit("linked").alias("kind"), F.count("*").alias("n"), F.min("a").alias("first"))
    return yes.union(keyed.join(linked, ["lo", "hi"], "left_anti").agg(F.lit("free"), F.count("*"), F.min("a")))


def common_neighbors(spark, sf_dir):
    return graph.common_neighbors(T.triples(spark, sf_dir), "Q2000000003", "Q8000000003")


QUERIES = {
    **{q: partial(golden_of, t) for q, t in NAMES.items()},
    **{f"{q}_uncapped": partial(golden_of, t, max_answers=None) for q, t in NAMES.items()},
    "anchor_pool_by_template": anchor_pools,
    "entity_degrees": entity_degrees,
    "get_entity_card": get_entity_card,
    "neighbors_out_page": partial(page, direction="out"),
    "neighbors_in_page": partial(page, direction="in", limit=10, offset=10),
    "neighbors_both_page": partial(page, limit=40),
    "neighbors_relation_filter": partial(page, relation="P17"),
    "shortest_paths_pairs": shortest_paths_pairs,
    "shortest_paths_titled": shortest_paths_titled,
    "node_union_missing_titles": node_union_missing_titles,
    "triple_label_join": triple_label_join,
    "graph_hop_pick": hop_pick,
    "edge_exists_either_way": edge_pairs,
    "intersect_neighbors": common_neighbors,
}
ORACLES = {
    **{q: golden_sql(TEMPLATES[t], T.TRIPLE_CTE) for q, t in NAMES.items()},
    "anchor_pool_by_template": _anchor_sql(),
    "entity_degrees": f"WITH {T.TRIPLE_CTE} SELECT qid, CAST(sum(o) AS BIGINT) AS degree_out, CAST(sum(i) AS BIGINT) AS degree_in FROM (SELECT src AS qid, 1 AS o, 0 AS i FROM triple UNION ALL SELECT dst, 0, 1 FROM triple) GROUP BY qid",
    "get_entity_card": f"""
WITH {T.TRIPLE_CTE}, {T.ENTITY_CTE}, {T.ALIAS_CTE}, n AS (SELECT qid FROM entity UNION SELECT src FROM triple UNION SELECT dst FROM triple)
SELECT n.qid, coalesce(e.title, n.qid) AS title, sha256(coalesce(e.abstract, '')) AS abstract, coalesce(a.names, '') AS aliases, coalesce(i.c, 0) AS degree_in, coalesce(o.c, 0) AS degree_out
FROM n LEFT JOIN entity e ON e.qid = n.qid LEFT JOIN (SELECT qid, string_agg(alias, ',' ORDER BY pos) AS names FROM alias GROUP BY qid) a ON a.qid = n.qid
LEFT JOIN (SELECT dst, count(*) AS c FROM triple GROUP BY dst) i ON i.dst = n.qid LEFT JOIN (SELECT src, count(*) AS c FROM triple GROUP BY src) o ON o.src = n.qid""",
    "neighbors_out_page": _page_sql(f"src = '{HUB}'"),
    "neighbors_in_page": _page_sql(f"dst = '{HUB}'", 10, 10),
    "neighbors_both_page": _page_sql(f"src = '{HUB}' OR dst = '{HUB}'", 40),
    "neighbors_relation_filter": _page_sql(f"(src = '{HUB}' OR dst = '{HUB}') AND rel = 'P17'"),
    "shortest_paths_pairs": _paths_sql(),
    "shortest_paths_titled": f"""
{_paths_sql().replace("SELECT s, t, CAST(n AS BIGINT) AS length, path FROM ranked WHERE k <= 20", "")}, {T.ENTITY_CTE}, {T.RELATION_CTE},
p AS (SELECT s, t, n, path, regexp_extract_all(path, 'Q[0-9]+') AS ids, regexp_extract_all(path, '[-<]P[0-9]+[->]') AS hops FROM ranked WHERE k <= 20),
v AS (SELECT path, string_agg(coalesce(title, id), '|' ORDER BY i) AS titles FROM (SELECT DISTINCT path, unnest(ids) AS id, unnest(range(len(ids))) AS i FROM p) LEFT JOIN entity ON qid = id GROUP BY path),
h AS (SELECT DISTINCT path, ids, unnest(hops) AS hop, unnest(range(len(hops))) AS i FROM p),
e AS (SELECT path, string_agg(CASE WHEN hop LIKE '-%' THEN ids[i + 1] ELSE ids[i + 2] END || ' ' || r || ' ' || coalesce(label, r) || ' ' || CASE WHEN hop LIKE '-%' THEN ids[i + 2] ELSE ids[i + 1] END, '|' ORDER BY i) AS edges
  FROM (SELECT *, regexp_extract(hop, 'P[0-9]+') AS r FROM h) LEFT JOIN relation ON pid = r GROUP BY path)
SELECT s, t, CAST(n AS BIGINT) AS length, array_to_string(ids, ',') AS ids, titles, edges FROM p JOIN v USING (path) JOIN e USING (path)""",
    "node_union_missing_titles": f"WITH {T.TRIPLE_CTE}, {T.ENTITY_CTE} SELECT qid, title FROM entity UNION ALL SELECT qid, qid FROM (SELECT src AS qid FROM triple UNION SELECT dst FROM triple) WHERE qid NOT IN (SELECT qid FROM entity)",
    "triple_label_join": f"WITH {T.TRIPLE_CTE}, {T.RELATION_CTE} SELECT rel, coalesce(label, rel) AS rel_label, count(*) AS n, min(src) AS first_src FROM triple LEFT JOIN relation ON pid = rel AND pid <> 'P127' GROUP BY 1, 2",
    "graph_hop_pick": f"""
WITH {T.TRIPLE_CTE}, r AS (SELECT src, rel, dst, row_number() OVER (PARTITION BY src ORDER BY rel, dst) AS n FROM triple WHERE src IN (SELECT src FROM triple WHERE rel = 'P69'))
SELECT src AS qid, arg_min(rel, sha256('3|' || src || '|' || rel || '|' || dst)) AS rel, arg_min(dst, sha256('3|' || src || '|' || rel || '|' || dst)) AS dst FROM r WHERE n <= 25 GROUP BY src""",
    "edge_exists_either_way": f"""
WITH {T.TRIPLE_CTE}, c AS (SELECT 'Q' || (3000000000 + c_custkey) AS a, 'Q' || (4000000000 + c_custkey // 6) AS b FROM customer),
x AS (SELECT a, EXISTS (SELECT 1 FROM triple t WHERE (t.src = a AND t.dst = b) OR (t.src = b AND t.dst = a)) AS e FROM c)
SELECT 'linked' AS kind, count(*) AS n, min(a) AS first FROM x WHERE e UNION ALL SELECT 'free', count(*), min(a) FROM x WHERE NOT e""",
    "intersect_neighbors": f"""
WITH {T.TRIPLE_CTE} SELECT dst AS qid FROM (SELECT dst FROM triple WHERE src = 'Q2000000003' UNION SELECT src FROM triple WHERE dst = 'Q2000000003')
INTERSECT (SELECT dst FROM triple WHERE src = 'Q8000000003' UNION SELECT src FROM triple WHERE dst = 'Q8000000003')""",
}
ORACLES |= {f"{q}_uncapped": uncapped(ORACLES[q]) for q in NAMES}
