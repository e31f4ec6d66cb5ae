"""Titles, aliases and text links: lookups that keep order, and similarity links confirmed by mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.ids import number_of
from lattica.functions.text import mentioned, snippet_sentence, title_rule, title_variants


def title_entities(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(qid, title, abstract) from texts (qid, abstract) and aliases (qid, pos, alias); ids with aliases alone come too, without abstract."""
    names = aliases.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "alias"))), lambda x: x["alias"]).alias("names"))
    both = texts.join(names, "qid", "full")
    listed = F.coalesce("names", F.array().cast("array<string>"))
    return both.select("qid", title_rule(listed, F.col("abstract"), F.col("qid")).alias("title"), "abstract")


def alias_only(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(qid, title) of ids that have aliases but no text; the title is the first alias."""
    rest = aliases.join(texts.select("qid"), "qid", "left_anti")
    return rest.groupBy("qid").agg(F.min_by("alias", "pos").alias("title"))


def lookup(titles: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """(title, qid): every id that has a variant of the title as alias; where there is none, ids of that very title."""
    wanted = titles.select("title").distinct()
    variants = wanted.select("title", F.explode(title_variants(F.col("title"))).alias("alias"))
    hits = variants.join(aliases.select("alias", "qid"), "alias").select("title", "qid").distinct()
    rest = wanted.join(hits.select("title").distinct(), "title", "left_anti")
    return hits.union(rest.join(entities.select("title", "qid"), "title").select("title", "qid").distinct())


def lowest(found: DataFrame) -> DataFrame:
    """(title, qid) with the numerically lowest id of each title."""
    return found.groupBy("title").agg(F.min_by("qid", F.struct(number_of(F.col("qid")), F.col("qid"))).alias("qid"))


def map_titles(lists: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, qids) from (id, titles ARRAY): the lowest id of each title, in order, once; titles without id drop out."""
    each = lists.select("id", F.posexplode("titles").alias("pos", "title"))
    got = each.join(lowest(lookup(each, aliases, entities)), "title")
    ranked = got.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "qid"))).alias("x"))
    return ranked.select("id", F.array_distinct(F.transform("x", lambda v: v["qid"])).alias("qids"))


def resolve(lists: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, rank, qid, title, snippet) from (id, qids ARRAY), order kept; unknown ids are titled by themselves."""
    each = lists.select("id", F.posexplode("qids").alias("rank", "qid"))
    found = each.join(entities, "qid", "left")
    return found.select("id", F.col("rank").cast("long").alias("rank"), "qid", F.coalesce("title", "qid").alias("title"), snippet_sentence(F.col("abstract")).alias("snippet"))


def text_links(near: DataFrame, texts: DataFrame, linked: DataFrame, most: int = 10) -> DataFrame:
    """Neighbours (q, id, rank) that the query's text mentions and that no edge links to it: (q, id, n).

    texts is (id, title, text), linked is undirected pairs (lo, hi). Neighbours come by rank, each once, at most ``most`` a query.
    """
    pairs = near.where("q <> id").groupBy("q", "id").agg(F.min("rank").alias("rank"))
    named = pairs.join(texts.select("id", "title"), "id").join(texts.select(F.col("id").alias("q"), "text"), "q")
    told = named.where(mentioned(F.col("title"), F.col("text"))).select("q", "id", "rank")
    free = told.join(linked, (F.least("q", "id") == F.col("lo")) & (F.greatest("q", "id") == F.col("hi")), "left_anti")
    w = Window.partitionBy("q").orderBy("rank", "id")
    return free.select("q", "id", F.row_number().over(w).cast("long").alias("n")).where(F.col("n") <= most)
