"""The derived knowledge graph: triples, entities and aliases from the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.session import table

# Relation ids and their labels.
RELATIONS = {
    "P17": "country",
    "P50": "author",
    "P57": "director",
    "P69": "educated at",
    "P106": "occupation",
    "P108": "employer",
    "P112": "founded by",
    "P127": "owned by",
    "P161": "cast member",
    "P463": "member of",
}
REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER, SEGMENT, GROUP = range(1, 9)


def qid(kind: int, key: Column) -> Column:
    """'Q' and kind * 10^9 + key."""
    return F.concat(F.lit("Q"), (F.lit(kind * 1_000_000_000).cast("long") + key.cast("long")).cast("string"))


def reader(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    """Opens each table once, when it is first asked for."""
    return cache(lambda name: table(spark, sf_dir, name))


def edges(spark: SparkSession, sf_dir: str, rel: str, read: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """(src, dst) of one relation; only its own tables and columns are read."""
    read = read or reader(spark, sf_dir)
    c = F.col
    if rel in ("P57", "P50"):
        rows = read("orders").where(c("o_orderkey") % 50 == (0 if rel == "P57" else 1))
        return rows.select(qid(ORDER, c("o_orderkey")).alias("src"), qid(CUSTOMER, c("o_custkey")).alias("dst"))
    if rel == "P161":
        return read("lineitem").where(c("l_orderkey") % 50 == 0).select(qid(ORDER, c("l_orderkey")).alias("src"), qid(PART, c("l_partkey")).alias("dst"))
    if rel == "P69":
        return read("customer").select(qid(CUSTOMER, c("c_custkey")).alias("src"), qid(NATION, c("c_nationkey")).alias("dst"))
    if rel == "P106":
        return read("customer").select(qid(CUSTOMER, c("c_custkey")).alias("src"), qid(SEGMENT, F.ascii("c_mktsegment")).alias("dst"))
    if rel == "P463":
        return read("customer").select(qid(CUSTOMER, c("c_custkey")).alias("src"), qid(GROUP, c("c_custkey") % 25).alias("dst"))
    if rel == "P108":
        of = read("supplier").agg(F.count("*").alias("n")).scalar()
        rows = read("customer").where(c("c_custkey") % 6 == 0)
        return rows.select(qid(CUSTOMER, c("c_custkey")).alias("src"), qid(SUPPLIER, F.expr("c_custkey div 6") % of).alias("dst"))
    if rel == "P112":
        of = read("customer").agg(F.count("*").alias("n")).scalar()
        return read("supplier").select(qid(SUPPLIER, c("s_suppkey")).alias("src"), qid(CUSTOMER, c("s_suppkey") * 7 % of).alias("dst"))
    if rel == "P127":
        return read("supplier").select(qid(SUPPLIER, c("s_suppkey")).alias("src"), qid(SUPPLIER, F.expr("(s_suppkey div 10) * 10")).alias("dst"))
    if rel == "P17":
        return read("nation").select(qid(NATION, c("n_nationkey")).alias("src"), qid(REGION, c("n_regionkey")).alias("dst"))
    raise ValueError(f"unknown relation {rel!r}")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, rel, dst) of all relations, parallel edges kept. A filter on rel prunes the other branches."""
    read = reader(spark, sf_dir)
    parts = [edges(spark, sf_dir, rel, read).select("src", F.lit(rel).alias("rel"), "dst") for rel in RELATIONS]
    return reduce(DataFrame.unionByName, parts)


def relation_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(RELATIONS.items()), "pid string, label string")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, title) of the entities; texts aren't read."""
    read = lambda name: table(spark, sf_dir, name)
    named = ((REGION, "region", "r_regionkey", "r_name"), (NATION, "nation", "n_nationkey", "n_name"), (CUSTOMER, "customer", "c_custkey", "c_name"), (SUPPLIER, "supplier", "s_suppkey", "s_name"), (PART, "part", "p_partkey", "p_name"))
    return reduce(DataFrame.unionByName, [read(name).select(qid(kind, F.col(key)).alias("qid"), F.col(title).alias("title")) for kind, name, key, title in named])


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, title, abstract): named dimensions; customers have a document as abstract; orders and groups have no row."""
    read = lambda name: table(spark, sf_dir, name)
    none = F.lit(None).cast("string").alias("abstract")
    docs = read("documents").select(F.col("doc_id").alias("c_custkey"), F.col("text").alias("abstract"))
    return reduce(
        DataFrame.unionByName,
        [
            read("region").select(qid(REGION, F.col("r_regionkey")).alias("qid"), F.col("r_name").alias("title"), none),
            read("nation").select(qid(NATION, F.col("n_nationkey")).alias("qid"), F.col("n_name").alias("title"), none),
            read("customer").join(docs, "c_custkey", "left").select(qid(CUSTOMER, F.col("c_custkey")).alias("qid"), F.col("c_name").alias("title"), "abstract"),
            read("supplier").select(qid(SUPPLIER, F.col("s_suppkey")).alias("qid"), F.col("s_name").alias("title"), none),
            read("part").select(qid(PART, F.col("p_partkey")).alias("qid"), F.col("p_name").alias("title"), none),
        ],
    )


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, pos, alias) of parts: name, brand, brand in lower case."""
    names = F.array(F.col("p_name"), F.col("p_brand"), F.lower("p_brand"))
    return table(spark, sf_dir, "part").select(qid(PART, F.col("p_partkey")).alias("qid"), F.posexplode(names).alias("pos", "alias"))


TRIPLE_CTE = """
triple(src, rel, dst) AS (
  SELECT 'Q' || (6000000000 + o_orderkey), 'P57', 'Q' || (3000000000 + o_custkey) FROM orders WHERE o_orderkey % 50 = 0
  UNION ALL SELECT 'Q' || (6000000000 + l_orderkey), 'P161', 'Q' || (5000000000 + l_partkey) FROM lineitem WHERE l_orderkey % 50 = 0
  UNION ALL SELECT 'Q' || (6000000000 + o_orderkey), 'P50', 'Q' || (3000000000 + o_custkey) FROM orders WHERE o_orderkey % 50 = 1
  UNION ALL SELECT 'Q' || (3000000000 + c_custkey), 'P69', 'Q' || (2000000000 + c_nationkey) FROM customer
  UNION ALL SELECT 'Q' || (3000000000 + c_custkey), 'P106', 'Q' || (7000000000 + ascii(c_mktsegment)) FROM customer
  UNION ALL SELECT 'Q' || (3000000000 + c_custkey), 'P463', 'Q' || (8000000000 + c_custkey % 25) FROM customer
  UNION ALL SELECT 'Q' || (3000000000 + c_custkey), 'P108', 'Q' || (4000000000 + (c_custkey // 6) % (SELECT count(*) FROM supplier)) FROM customer WHERE c_custkey % 6 = 0
  UNION ALL SELECT 'Q' || (4000000000 + s_suppkey), 'P112', 'Q' || (3000000000 + (s_suppkey * 7) % (SELECT count(*) FROM customer)) FROM supplier
  UNION ALL SELECT 'Q' || (4000000000 + s_suppkey), 'P127', 'Q' || (4000000000 + (s_suppkey // 10) * 10) FROM supplier
  UNION ALL SELECT 'Q' || (2000000000 + n_nationkey), 'P17', 'Q' || (1000000000 + n_regionkey) FROM nation
)"""
ENTITY_CTE = """
entity(qid, title, abstract) AS (
  SELECT 'Q' || (1000000000 + r_regionkey), r_name, NULL FROM region
  UNION ALL SELECT 'Q' || (2000000000 + n_nationkey), n_name, NULL FROM nation
  UNION ALL SELECT 'Q' || (3000000000 + c_custkey), c_name, d.text FROM customer LEFT JOIN documents d ON d.doc_id = c_custkey
  UNION ALL SELECT 'Q' || (4000000000 + s_suppkey), s_name, NULL FROM supplier
  UNION ALL SELECT 'Q' || (5000000000 + p_partkey), p_name, NULL FROM part
)"""
ALIAS_CTE = """
alias(qid, pos, alias) AS (
  SELECT 'Q' || (5000000000 + p_partkey), 0, p_name FROM part
  UNION ALL SELECT 'Q' || (5000000000 + p_partkey), 1, p_brand FROM part
  UNION ALL SELECT 'Q' || (5000000000 + p_partkey), 2, lower(p_brand) FROM part
)"""
RELATION_CTE = "relation(pid, label) AS (VALUES " + ", ".join(f"('{p}', '{label}')" for p, label in sorted(RELATIONS.items())) + ")"
