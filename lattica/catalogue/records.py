"""Question records, sampler rows, draws, datasets and text vectors, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.catalogue.graphs import edges_of
from lattica.catalogue.texts import titles_asked
from lattica.functions import parsing
from lattica.operators import evaluation, records, splits, vectors
from lattica.plans import triples as T
from lattica.plans.templates import TEMPLATES, golden, golden_sql
from lattica.session import table
from lattica.sources import files


def _lists(df: DataFrame) -> DataFrame:
    """Lists as text, in their order."""
    return df.select("id", "question", F.array_join("answer_qids", ",").alias("answers"), F.array_join("bridge_qids", ",").alias("bridges"), "source", F.coalesce("cypher", F.lit("")).alias("query"), F.col("difficulty").cast("long").alias("difficulty"))


def pattern_records(spark, sf_dir):
    """A record of every golden set of every template."""
    edges = edges_of(spark, sf_dir)
    return _lists(reduce(DataFrame.unionByName, [records.pattern_records(golden(t, edges), t, F.concat(F.lit(f"Which {t.answer} of "), "anchors", F.lit("?"))) for t in TEMPLATES.values()]))


def _pattern_sql() -> str:
    parts = []
    for t in TEMPLATES.values():
        text = f"'{records.query_of(t)}'"
        for name in sorted(t.anchors, key=lambda n: (-len(n), n)):
            text = f"replace({text}, '${name}', chr(39) || string_split(anchors, '|')[{t.anchors.index(name) + 1}] || chr(39))"
        parts.append(f"SELECT id, 'Which {t.answer} of ' || anchors || '?' AS question, answers, bridges, 'kg_pattern' AS source, {text} AS query, difficulty FROM ({golden_sql(t, T.TRIPLE_CTE)})")
    return " UNION ALL ".join(parts)


def link_records(spark, sf_dir):
    """A record of each customer's nation, with the nation's suppliers as answers where there are at most five."""
    c = table(spark, sf_dir, "customer").select(T.qid(T.CUSTOMER, F.col("c_custkey")).alias("anchor"), T.qid(T.NATION, F.col("c_nationkey")).alias("target"), F.col("c_nationkey").alias("n"))
    s = table(spark, sf_dir, "supplier")
    few = s.groupBy("s_nationkey").agg(F.count("*").alias("k")).where("k <= 5").select(F.col("s_nationkey").alias("n2"))
    s = s.join(few, F.col("s_nationkey") == F.col("n2"), "left_semi").groupBy(F.col("s_nationkey").alias("n2")).agg(F.collect_set(T.qid(T.SUPPLIER, F.col("s_suppkey"))).alias("x"))
    links = c.join(s, F.col("n") == F.col("n2")).select("anchor", "target", F.array_sort("x").alias("answers"))
    return _lists(records.link_records(links, F.concat(F.lit("Who is near "), "anchor", F.lit("?"))))


def benchmark_records(spark, sf_dir):
    """Records of parts as benchmark rows, some of which have no question and some no title."""
    asked = F.when(F.col("id") % 7 != 0, F.concat(F.lit(" Which "), F.col("id").cast("string"), F.lit("? "))).otherwise(" ")
    rows = titles_asked(spark, sf_dir).select(F.col("id").alias("idx"), asked.alias("question"), F.slice("titles", F.lit(1), (F.col("id") % 5).cast("int")).alias("titles"))
    return _lists(records.benchmark_records(rows, T.aliases(spark, sf_dir).where("pos > 0"), T.titles(spark, sf_dir)))


def anchor_rows(spark, sf_dir):
    """Anchors of sampler rows, without titles for some, and the line that describes each."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(T.qid(T.CUSTOMER, k).alias("qid_who"), F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("c_name")).alias("title_who"), k.alias("k"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k2"), "text")
    both = rows.join(docs, F.col("k") == F.col("k2"), "left").select(records.anchors_of(("who",)).alias("a"), "text")
    line = records.anchor_line(F.col("a.who.title"), F.lit("a person"), F.col("text"))
    return both.select("a.who.qid", "a.who.title", F.sha2(line, 256).alias("line"))


def first_of_keys(spark, sf_dir):
    """The first key that a raw row has, over the columns of events."""
    df = table(spark, sf_dir, "events").withColumn("Prompt", F.when(F.col("event_id") % 2 == 0, F.col("event_type")))
    return df.select("event_id", records.first_of(df.columns, "Prompt", "missing", "props").alias("first"))


def dataset_rows(spark, sf_dir):
    """The benchmark through the dataset source."""
    return files.dataset(spark, f"{sf_dir}/benchmark.parquet").select("item_id", F.sha2("text", 256).alias("text"))


def _calls(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"))


def endpoint_mix(spark, sf_dir):
    """Load-test calls by endpoint, drawn at 60, 10, 25 and 5."""
    return splits.draw_weighted(_calls(spark, sf_dir), dict(zip(splits.TOOLS, (60, 10, 25, 5))), "endpoint", seed=9).groupBy("endpoint").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def difficulty_draw(spark, sf_dir):
    """The difficulty that each attempt tries, by what the quota still lacks."""
    got = splits.next_difficulty(_calls(spark, sf_dir), splits.parse_mix("40,35,25"), 100, {2: 35, 3: 10, 4: 30}, seed=3)
    return got.groupBy(F.col("difficulty").cast("long").alias("difficulty")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


def run_stops(spark, sf_dir):
    """Why a user's run ends after its events, and a line on its progress."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("accepted"), F.count("*").alias("attempts"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cost"))
    why = splits.stop_reason(F.col("accepted"), F.col("attempts"), F.col("cost"), 3, 12, 30000)
    line = evaluation.progress(F.col("accepted"), F.col("attempts"), 10, F.col("attempts") * 4)
    return rows.select("user_id", F.coalesce(why, F.lit("")).alias("why"), line.alias("line"))


def budget_run(spark, sf_dir):
    """All events within one budget, in the order of their ids."""
    rows = table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return splits.within_budget(rows, 500000, order="event_id", cost="cents").select("event_id", "spent")


def call_numbers(spark, sf_dir):
    """Arguments of a call with a repeated parameter: the last counts, and whole numbers are numbers."""
    text = F.concat(F.lit("<function=f><parameter=k>1</parameter><parameter=t>"), "event_type", F.lit("</parameter><parameter=k>"), F.col("event_id").cast("string"), F.lit("</parameter></function>"))
    rows = table(spark, sf_dir, "events").select("event_id", parsing.with_numbers(parsing.parse_function_calls(text))[0].alias("c"))
    return rows.select("event_id", F.col("c.name").alias("name"), F.col("c.arguments")["t"].alias("t"), F.col("c.numbers")["k"].alias("k"), F.size("c.numbers").cast("long").alias("n"))


def text_vectors(spark, sf_dir):
    """Documents as vectors of hashed words, through the model interface."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", "[^a-zA-Z ]", "").alias("text"))
    got = vectors.embed(docs, vectors.hashed_words(16), 16)
    return got.select("id", F.array_join(F.transform("vec", lambda x: x.cast("long").cast("string")), ",").alias("vec"))


QUERIES = {f.__name__: f for f in (pattern_records, link_records, benchmark_records, anchor_rows, first_of_keys, dataset_rows, endpoint_mix, difficulty_draw, run_stops, budget_run, call_numbers, text_vectors)}
_U = "CAST('0x' || left(sha256('{seed}|' || id), 12) AS BIGINT) / 281474976710656.0"
_BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
ORACLES = {
    "pattern_records": _pattern_sql(),
    "link_records": """
WITH s AS (SELECT s_nationkey, list_sort(list('Q' || (4000000000 + s_suppkey))) AS x FROM supplier GROUP BY 1 HAVING count(*) <= 5),
l AS (SELECT 'Q' || (3000000000 + c_custkey) AS a, 'Q' || (2000000000 + c_nationkey) AS t, x FROM customer JOIN s ON s_nationkey = c_nationkey)
SELECT 'sim-' || left(sha1(a || '|' || array_to_string(x, '|')), 12) AS id, 'Who is near ' || a || '?' AS question, array_to_string(x, ',') AS answers, a || ',' || t AS bridges, 'sim_link' AS source, '' AS query, CAST(2 AS BIGINT) AS difficulty FROM l""",
    "benchmark_records": f"""
WITH {T.ENTITY_CTE}, {T.ALIAS_CTE}, k AS (SELECT p_partkey AS id, p_partkey % 5 AS n, [CASE p_partkey % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN p_name ELSE 'no ' || p_name END, p_name, p_brand, p_name] AS x FROM part WHERE p_partkey % 7 <> 0),
asked AS (SELECT id, unnest(x[1:n]) AS title, unnest(range(least(n, 4))) AS pos FROM k), names AS (SELECT alias, qid FROM alias WHERE pos > 0),
t AS (SELECT DISTINCT title FROM asked), v AS (SELECT DISTINCT title, unnest([title, lower(title), upper(title[1]) || lower(title[2:])]) AS alias FROM t), hit AS (SELECT DISTINCT title, qid FROM v JOIN names USING (alias)),
f AS (SELECT * FROM hit UNION SELECT t.title, e.qid FROM t JOIN entity e ON e.title = t.title WHERE t.title NOT IN (SELECT title FROM hit)),
low AS (SELECT title, arg_min(qid, CAST(qid[2:] AS BIGINT)) AS qid FROM f GROUP BY 1), o AS (SELECT id, qid, min(pos) AS pos FROM asked JOIN low USING (title) GROUP BY 1, 2),
g AS (SELECT id, string_agg(qid, ',' ORDER BY pos) AS answers FROM o GROUP BY 1)
SELECT 'frames-' || k.id AS id, 'Which ' || k.id || '?' AS question, answers, '' AS bridges, 'frames' AS source, '' AS query, CAST(greatest(1, n) AS BIGINT) AS difficulty FROM k JOIN g USING (id)""",
    "anchor_rows": f"""
WITH a AS (SELECT 'Q' || (3000000000 + c_custkey) AS qid, CASE WHEN c_custkey % 3 = 1 THEN c_name ELSE 'Q' || (3000000000 + c_custkey) END AS title, left(trim(regexp_replace(coalesce(text, ''), '{_BLANK}', ' ', 'g')), 200) AS t
FROM customer LEFT JOIN documents ON doc_id = c_custkey)
SELECT qid, title, sha256('"' || title || '" — must be a person — abstract: "' || CASE WHEN t = '' THEN '(no abstract available)' ELSE t END || '"') AS line FROM a""",
    "first_of_keys": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE props END AS first FROM events",
    "dataset_rows": "SELECT item_id, sha256(text) AS text FROM benchmark",
    "endpoint_mix": f"""WITH e AS (SELECT CAST(event_id AS VARCHAR) AS id FROM events), u AS (SELECT id, {_U.format(seed=9)} AS u FROM e)
SELECT CASE WHEN u < 0.6 THEN 'vector_search' WHEN u < 0.7 THEN 'get_entity' WHEN u < 0.95 THEN 'get_neighbors' ELSE 'find_paths' END AS endpoint, count(*) AS n, min(id) AS first FROM u GROUP BY 1""",
    "difficulty_draw": f"""WITH e AS (SELECT CAST(event_id AS VARCHAR) AS id FROM events), u AS (SELECT id, {_U.format(seed=3)} AS u FROM e)
SELECT CAST(CASE WHEN u < CAST(5 AS DOUBLE) / 30 THEN 2 ELSE 3 END AS BIGINT) AS difficulty, count(*) AS n, min(id) AS first FROM u GROUP BY 1""",
    "run_stops": """WITH r AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS a, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS c FROM events GROUP BY 1)
SELECT user_id, CASE WHEN a >= 3 THEN 'target' WHEN n >= 12 THEN 'attempts' WHEN c >= 30000 THEN 'budget' ELSE '' END AS why,
printf('%d/10 accepted, %.1f%% of %d attempts, %.2f/s, %.0f s to go', a, a / n * 100, n, CAST(0.25 AS DOUBLE), CASE WHEN a > 0 THEN greatest(10 - a, 0) / (a / (n * 4)) ELSE CAST(-1 AS DOUBLE) END) AS line FROM r""",
    "budget_run": "WITH r AS (SELECT event_id, sum(CAST(round(value * 100) AS BIGINT)) OVER (ORDER BY event_id) AS s FROM events) SELECT event_id, CAST(s AS BIGINT) AS spent FROM r WHERE s <= 500000",
    "call_numbers": "SELECT event_id, 'f' AS name, event_type AS t, event_id AS k, CAST(1 AS BIGINT) AS n FROM events",
    "text_vectors": """WITH w AS (SELECT doc_id AS id, unnest(list_filter(string_split(lower(regexp_replace(text, '[^a-zA-Z ]', '', 'g')), ' '), lambda x: x <> '')) AS w FROM documents),
c AS (SELECT id, CAST('0x' || left(md5(w), 1) AS INT) AS b, count(*) AS n FROM w GROUP BY 1, 2), g AS (SELECT doc_id AS id, unnest(range(16)) AS b FROM documents)
SELECT g.id, string_agg(CAST(coalesce(c.n, 0) AS VARCHAR), ',' ORDER BY g.b) AS vec FROM g LEFT JOIN c ON c.id = g.id AND c.b = g.b GROUP BY 1""",
}
