"""Titles, snippets, links, lookups and parsers over text built from the tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from lattica.functions import ids, parsing
from lattica.functions import text as X
from lattica.operators import resolve
from lattica.plans import triples as T
from lattica.session import table

WS_SQL = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
FLAT = f"trim(regexp_replace(text, '{WS_SQL}+', ' ', 'g'), ' ')"
NL = "chr(10)"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def doc_text(spark, sf_dir):
    t = X.doc_text(F.concat(F.lit("Doc "), F.col("doc_id").cast("string")), F.col("text"))
    return docs(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", F.sha2("t", 256).alias("doc_text"), parsing.words_in(F.col("t")).cast("long").alias("words"))


def snippets(spark, sf_dir):
    t = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", X.snippet_raw(t).alias("a"), X.snippet_flat(t).alias("b"), X.snippet_sentence(t).alias("c"))


def title_rule(spark, sf_dir):
    """Customers' documents with aliases cut from their first words: prefixes of two lengths and a stranger."""
    head = X.collapse(F.col("text"))
    some = F.array(X.upper_each(F.substring(head, 1, 3)), F.concat(F.lit("x"), F.substring(head, 1, 9)), X.lower_each(F.substring(head, 1, 6)), F.substring(head, 1, 6))
    names = docs(spark, sf_dir).select(F.concat(F.lit("Q"), F.col("doc_id").cast("string")).alias("qid"), F.posexplode(some).alias("pos", "alias")).where("qid not like '%5'")
    texts = docs(spark, sf_dir).where("doc_id % 3 <> 0").select(F.concat(F.lit("Q"), F.col("doc_id").cast("string")).alias("qid"), F.concat(F.lit('  "'), F.coalesce("text", F.lit(""))).alias("abstract"))
    return resolve.title_entities(texts, names).select("qid", "title", F.col("abstract").isNull().alias("alias_only"))


def alias_only(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(T.qid(T.PART, F.col("p_partkey")).alias("qid"))
    return resolve.alias_only(parts, T.aliases(spark, sf_dir))


def url_titles(spark, sf_dir):
    url = F.regexp_replace("url", "^[a-z]+://", "https://x/wiki/")
    odd = F.concat(F.lit("https://x/wiki/A_b%20c+d_"), F.col("page_id").cast("string"), F.lit("?q=1#z"))
    return table(spark, sf_dir, "pages").select("page_id", X.title_from_url(url).alias("title"), X.title_from_url(odd).alias("odd"), X.title_from_url(F.col("url")).alias("none"))


def link_lists(spark, sf_dir):
    url = F.regexp_replace("url", "[#?].*$", "")
    told = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("['"), url, F.lit("', '"), url, F.lit("/b', ' ']"))).otherwise(F.concat(F.lit("see "), url, F.lit(" and "), url, F.lit("/c")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(X.parse_links(told), " ").alias("links"))


def title_filter(spark, sf_dir):
    odd = F.when(F.col("p_partkey") % 5 == 0, F.lit("  ")).when(F.col("p_partkey") % 5 == 1, F.concat("p_name", F.lit("/x"))).when(F.col("p_partkey") % 5 == 2, F.col("q")).otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").withColumn("q", T.qid(T.PART, F.col("p_partkey")))
    return rows.select("q", odd.alias("title")).where(X.title_ok(F.col("title"), F.col("q")))


def titles_asked(spark, sf_dir):
    brand = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_brand")).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.concat(F.lit("no "), "p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(brand, F.col("p_name"), F.col("p_brand"), F.col("p_name")).alias("titles"))


def title_lookup(spark, sf_dir):
    asked = titles_asked(spark, sf_dir).select(F.explode("titles").alias("title"))
    return resolve.lookup(asked, T.aliases(spark, sf_dir).where("pos > 0"), T.entities(spark, sf_dir)).groupBy("title").agg(F.count("*").alias("n"), F.min("qid").alias("first"))


def title_lists(spark, sf_dir):
    got = resolve.map_titles(titles_asked(spark, sf_dir), T.aliases(spark, sf_dir).where("pos > 0"), T.entities(spark, sf_dir))
    return got.select("id", F.array_join("qids", ",").alias("qids"))


def rank_lists(spark, sf_dir):
    some = F.array(T.qid(T.CUSTOMER, F.col("n_nationkey") * 3), T.qid(T.NATION, F.col("n_nationkey")), F.concat(F.lit("Q9"), F.col("n_nationkey").cast("string")), T.qid(T.CUSTOMER, F.col("n_nationkey")))
    return resolve.resolve(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), some.alias("qids")), T.entities(spark, sf_dir))


def answer_text():
    """Text with two answer blocks: the last counts, comments and repeats go."""
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    lines = [
        F.lit("Thinking.\n```entities\nQ1\n```\nBetter:\n```Entities \n"), F.lit("Q"), s(k), F.lit(" # top\n  q"), s(k + 1), F.lit(" // Q999\n# Q5\n- Q"), s(k % 3), F.lit(", Q77\nnone\nQ"), s(k),
        F.when(k % 4 == 0, F.lit("\nQ12x")).otherwise(F.lit("\n0Q13")), F.when(k % 5 == 0, F.lit("\n")).otherwise(F.lit("\n```\ndone")),
    ]
    return F.concat(*lines)


def answer_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", answer_text().alias("t"))
    return rows.select("o_orderkey", F.array_join(parsing.parse_entities(F.col("t")), ",").alias("qids"), F.array_join(parsing.parse_entities_strict(F.col("t")), ",").alias("strict"))


def answer_clean(spark, sf_dir):
    """Validated, de-duplicated and numerically sorted id lists."""
    some = F.array(*(F.concat(F.lit("Q"), (F.col("o_orderkey") * m % 101).cast("string")) for m in (7, 3, 11, 7)))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", ids.clean_qids(some).alias("q"))
    return rows.select("o_orderkey", F.array_join("q", ",").alias("qids"), F.array_join(ids.sort_numeric(F.col("q")), ",").alias("ordered"))


def tool_calls(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    call = lambda name, args: F.concat(F.lit('<tool_call>{"name": "'), name, F.lit('", "arguments": '), args, F.lit("}</tool_call>"))
    good = call(F.col("event_type"), F.concat(F.lit('{"k": '), k, F.lit("}")))
    text = F.concat(F.lit("<think>hm</think> a "), good, F.lit(" b <tool_call>{bad}</tool_call> <tool_call>{\"arguments\": {}}</tool_call> "), call(F.lit("again"), F.concat(F.lit('"{\\"q\\": '), k, F.lit('}"'))))
    xml = F.concat(F.lit("<tool_call><function=f"), F.col("event_type"), F.lit("><parameter=k> "), k, F.lit(" </parameter><parameter=q>a b</parameter></function></tool_call> end"))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("t"), xml.alias("x"))
    named = lambda calls: F.array_join(F.transform(calls, lambda c: F.concat(c["name"], F.lit(":"), F.array_join(F.transform(F.array_sort(F.map_entries(c["arguments"])), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&"))), " ")
    return rows.select("event_id", named(parsing.parse_tool_calls(F.col("t"))).alias("hermes"), named(parsing.parse_function_calls(F.col("x"))).alias("functions"), parsing.strip_markup(F.col("t")).alias("rest"), parsing.strip_markup(F.col("x")).alias("rest_x"))


def judge(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    pids = F.when(k % 3 == 0, F.lit('"p69", " P57 "')).when(k % 3 == 1, F.lit('"P57", "P69", "P69"')).otherwise(F.lit('"P57"'))
    reply = F.when(k % 10 == 9, F.lit("no idea")).otherwise(F.concat(F.lit('I think {"pids": ['), pids, F.lit('], "unique": '), (k % 2 == 0).cast("string"), F.lit(', "reason": "r"} so')))
    rows = table(spark, sf_dir, "events").select("event_id", reply.alias("t"), F.concat(F.lit("<question> What\n is "), k.cast("string"), F.lit("?</question><reject> </reject>")).alias("q"))
    j = parsing.parse_judge(F.col("t"))
    accepts = parsing.judge_accepts(j, F.array(F.lit("P69"), F.lit("P57")))
    return rows.select("event_id", F.array_join(j["pids"], ",").alias("pids"), F.coalesce(j["unique"], F.lit(False)).alias("is_unique"), accepts.alias("accepted"), parsing.parse_tag(F.col("q"), "question").alias("question"), parsing.parse_reject(F.col("q")).alias("reject"))


def scaffolds(spark, sf_dir):
    n = F.col("n_nationkey").cast("long")
    filled = X.fill(F.lit("Films by {a} of {b}"), {"a": (F.col("n_name"), T.qid(T.NATION, n)), "b": (F.lit("x"), F.lit("Q1"))})
    return table(spark, sf_dir, "nation").select(
        n.alias("id"), filled.alias("filled"), X.link_scaffold(F.col("n_name"), F.lit("P69"), n % 3).alias("linked"),
        F.array_join(X.relation_words(F.array(F.lit("P69"), F.lit("P9999")), T.RELATIONS), "; ").alias("words"), X.truncate(F.repeat("n_name", 3), 12).alias("short"), X.safe_name(F.concat(F.lit("a/b:"), "n_name")).alias("file"),
    )


QUERIES = {
    "doc_text": doc_text,
    "snippets_abc": snippets,
    "title_rule": title_rule,
    "alias_only_entities": alias_only,
    "url_titles": url_titles,
    "link_lists": link_lists,
    "title_filter": title_filter,
    "title_lookup_variants": title_lookup,
    "title_list_to_ids": title_lists,
    "resolve_rank_list": rank_lists,
    "answer_parse": answer_parse,
    "answer_clean": answer_clean,
    "tool_call_parse": tool_calls,
    "judge_multiset": judge,
    "scaffold_text": scaffolds,
}
_ASKED = """
asked AS (SELECT p_partkey AS id, unnest([1, 2, 3, 4]) AS pos, unnest([CASE p_partkey % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN p_name ELSE 'no ' || p_name END, p_name, p_brand, p_name]) AS title FROM part)"""
_FOUND = f"""
{T.ENTITY_CTE}, {T.ALIAS_CTE}, {_ASKED}, w AS (SELECT DISTINCT title FROM asked),
hits AS (SELECT DISTINCT w.title, a.qid FROM w JOIN alias a ON a.pos > 0 AND a.alias IN (w.title, lower(w.title), upper(left(w.title, 1)) || lower(substr(w.title, 2)))),
found AS (SELECT * FROM hits UNION ALL SELECT DISTINCT w.title, e.qid FROM w JOIN entity e ON e.title = w.title WHERE w.title NOT IN (SELECT title FROM hits))"""
ORACLES = {
    "doc_text": f"""WITH t AS (SELECT doc_id, 'Doc ' || doc_id || '. ' || array_to_string(string_split({FLAT}, ' ')[1:400], ' ') AS t FROM documents)
SELECT doc_id, sha256(t) AS doc_text, CAST(len(list_filter(string_split(regexp_replace(t, '{WS_SQL}+', ' ', 'g'), ' '), lambda x: x <> '')) AS BIGINT) AS words FROM t""",
    "snippets_abc": f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS text FROM documents), f AS (SELECT doc_id, text, {FLAT} AS t FROM d)
SELECT doc_id, substr(text, 1, 200) AS a, CASE WHEN t = '' THEN '(no description)' ELSE substr(t, 1, 150) END AS b,
CASE WHEN instr(t, '. ') BETWEEN 1 AND 200 THEN substr(t, 1, instr(t, '. ')) WHEN length(t) <= 200 THEN t ELSE rtrim(substr(t, 1, 200)) || '…' END AS c FROM f""",
    "title_rule": f"""WITH d AS (SELECT doc_id, 'Q' || doc_id AS qid, {FLAT} AS h FROM documents), a AS (
  SELECT qid, 0 AS pos, upper(left(h, 3)) AS alias, h FROM d UNION ALL SELECT qid, 1, 'x' || left(h, 9), h FROM d UNION ALL SELECT qid, 2, lower(left(h, 6)), h FROM d UNION ALL SELECT qid, 3, left(h, 6), h FROM d),
n AS (SELECT * FROM a WHERE qid NOT LIKE '%5'), t AS (SELECT qid, h FROM d WHERE doc_id % 3 <> 0),
b AS (SELECT n.qid, n.alias, row_number() OVER (PARTITION BY n.qid ORDER BY length(trim(replace(lower(n.alias), 'ß', 'ss'), ' ')) DESC, n.pos) AS k FROM n JOIN t ON t.qid = n.qid WHERE starts_with(replace(lower(t.h), 'ß', 'ss'), trim(replace(lower(n.alias), 'ß', 'ss'), ' '))),
f AS (SELECT qid, arg_min(alias, pos) AS alias FROM n GROUP BY qid), q AS (SELECT qid FROM t UNION SELECT qid FROM n)
SELECT q.qid, coalesce(b.alias, f.alias, q.qid) AS title, t.qid IS NULL AS alias_only FROM q LEFT JOIN b ON b.qid = q.qid AND b.k = 1 LEFT JOIN f ON f.qid = q.qid LEFT JOIN t ON t.qid = q.qid""",
    "alias_only_entities": f"WITH {T.ALIAS_CTE} SELECT qid, alias AS title FROM alias WHERE pos = 0 AND qid NOT IN (SELECT 'Q' || (5000000000 + p_partkey) FROM part WHERE p_partkey % 2 = 0)",
    "url_titles": "WITH p AS (SELECT page_id, split_part(split_part(regexp_replace(url, '^[a-z]+://', ''), '#', 1), '?', 1) AS u FROM pages) SELECT page_id, nullif(trim(replace(url_decode(u), '_', ' ')), '') AS title, 'A b c+d ' || page_id AS odd, CAST(NULL AS VARCHAR) AS none FROM p",
    "link_lists": "WITH p AS (SELECT page_id, regexp_replace(url, '[#?].*$', '') AS u FROM pages) SELECT page_id, u || ' ' || u || CASE WHEN page_id % 2 = 0 THEN '/b' ELSE '/c' END AS links FROM p",
    "title_filter": "SELECT 'Q' || (5000000000 + p_partkey) AS q, p_name AS title FROM part WHERE p_partkey % 5 > 2",
    "title_lookup_variants": f"WITH {_FOUND} SELECT title, count(*) AS n, min(qid) AS first FROM found GROUP BY title",
    "title_list_to_ids": f"""WITH {_FOUND}, low AS (SELECT title, arg_min(qid, CAST(substr(qid, 2) AS BIGINT)) AS qid FROM found GROUP BY title),
g AS (SELECT a.id, low.qid, min(a.pos) AS pos FROM asked a JOIN low ON low.title = a.title GROUP BY 1, 2) SELECT id, string_agg(qid, ',' ORDER BY pos) AS qids FROM g GROUP BY id""",
    "resolve_rank_list": f"""WITH {T.ENTITY_CTE}, r AS (SELECT CAST(n_nationkey AS BIGINT) AS id, unnest([0, 1, 2, 3]) AS rank, unnest(['Q' || (3000000000 + n_nationkey * 3), 'Q' || (2000000000 + n_nationkey), 'Q9' || n_nationkey, 'Q' || (3000000000 + n_nationkey)]) AS qid FROM nation),
f AS (SELECT r.id, CAST(r.rank AS BIGINT) AS rank, r.qid, coalesce(e.title, r.qid) AS title, {FLAT.replace('text', "coalesce(e.abstract, '')")} AS t FROM r LEFT JOIN entity e ON e.qid = r.qid)
SELECT id, rank, qid, title, CASE WHEN instr(t, '. ') BETWEEN 1 AND 200 THEN substr(t, 1, instr(t, '. ')) WHEN length(t) <= 200 THEN t ELSE rtrim(substr(t, 1, 200)) || '…' END AS snippet FROM f""",
    "answer_parse": """WITH o AS (SELECT o_orderkey, o_orderkey AS k, o_orderkey % 5 = 0 AS open FROM orders),
q AS (SELECT o_orderkey, 1 AS p, 'Q' || k AS q FROM o UNION ALL SELECT o_orderkey, 2, 'Q' || (k + 1) FROM o UNION ALL SELECT o_orderkey, 3, 'Q' || (k % 3) FROM o),
d AS (SELECT o_orderkey, q, min(p) AS p FROM q GROUP BY 1, 2), a AS (SELECT o_orderkey, string_agg(q, ',' ORDER BY p) AS qids FROM d GROUP BY 1)
SELECT o.o_orderkey, CASE WHEN o.open THEN 'Q1' ELSE a.qids END AS qids, 'Q1' AS strict FROM o JOIN a ON a.o_orderkey = o.o_orderkey""",
    "answer_clean": """WITH q AS (SELECT o_orderkey, unnest([1, 2, 3, 4]) AS p, unnest([o_orderkey * 7 % 101, o_orderkey * 3 % 101, o_orderkey * 11 % 101, o_orderkey * 7 % 101]) AS n FROM orders), d AS (SELECT o_orderkey, n, min(p) AS p FROM q GROUP BY 1, 2)
SELECT o_orderkey, string_agg('Q' || n, ',' ORDER BY p) AS qids, string_agg('Q' || n, ',' ORDER BY n) AS ordered FROM d GROUP BY 1""",
    "tool_call_parse": """SELECT event_id, event_type || ':k=' || k || ' again:q=' || k AS hermes, 'f' || event_type || ':k=' || k || '&q=a b' AS functions, 'a  b' AS rest, 'end' AS rest_x
FROM (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events)""",
    "judge_multiset": """WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_id, CASE WHEN k % 10 = 9 THEN NULL WHEN k % 3 = 0 THEN 'P69,P57' WHEN k % 3 = 1 THEN 'P57,P69,P69' ELSE 'P57' END AS pids, k % 10 <> 9 AND k % 2 = 0 AS is_unique,
k % 10 <> 9 AND k % 2 = 0 AND k % 3 = 0 AS accepted, 'What is ' || k || '?' AS question, 'unspecified' AS reject FROM e""",
    "scaffold_text": """SELECT CAST(n_nationkey AS BIGINT) AS id, 'Films by "' || n_name || '" (Q' || (2000000000 + n_nationkey) || ') of "x" (Q1)' AS filled,
'Find the ' || (n_nationkey % 3) || CASE WHEN n_nationkey % 3 = 1 THEN ' entity' ELSE ' entities' END || ' that the description of ' || n_name || ' names, reached over P69.' AS linked,
'P69 (educated at); P9999 (P9999)' AS words, CASE WHEN length(n_name) * 3 > 12 THEN left(repeat(n_name, 3), 12) || '...[truncated]' ELSE repeat(n_name, 3) END AS short, 'a_b_' || n_name AS file FROM nation""",
}
