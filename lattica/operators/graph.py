"""Graph retrieval over triples (src, rel, dst): degrees, cards, neighbours, hops, paths, edge tests."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.ids import seeded, valid_pid, valid_qid
from lattica.session import ensure_checkpoint_dir

LIMITS = {"k": (1, 50, 10), "limit": (1, 100, 25), "max_hops": (1, 4, 3), "paths": (1, 20, 10), "query": (1, 4000, None)}


def bounded(name: str, value: int) -> int:
    low, high, _ = LIMITS[name]
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}, not {value}")
    return value


def check_qid(qid: str) -> str:
    if not re.fullmatch(r"Q[0-9]+", qid):
        raise ValueError(f"not a qid: {qid!r}")
    return qid


def label_edges(triples: DataFrame, labels: DataFrame) -> DataFrame:
    """Triples with rel_label; a relation without a label is labelled by its id. Labels are one row a relation, so Spark broadcasts them while they are small."""
    return triples.join(labels, F.col("rel") == F.col("pid"), "left").select("src", "rel", "dst", F.coalesce("label", "rel").alias("rel_label"))


def node_set(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """(qid, title): entities, and ids found in triples alone, which are titled by their qid."""
    ids = triples.select(F.col("src").alias("qid")).union(triples.select("dst")).distinct()
    known = entities.select("qid", F.coalesce("title", "qid").alias("title"))
    return known.unionByName(ids.join(known, "qid", "left_anti").select("qid", F.col("qid").alias("title")))


def degrees(triples: DataFrame) -> DataFrame:
    """(qid, degree_out, degree_in); a self-loop counts in both."""
    one, none = F.lit(1), F.lit(0)
    ends = triples.select(F.col("src").alias("qid"), one.alias("o"), none.alias("i")).union(triples.select("dst", none, one))
    return ends.groupBy("qid").agg(F.sum("o").alias("degree_out"), F.sum("i").alias("degree_in"))


def cards(entities: DataFrame, aliases: DataFrame, triples: DataFrame, most_aliases: int = 50) -> DataFrame:
    """qid, title, abstract, aliases (by place, at most 50), degree_in, degree_out of every entity or node."""
    names = aliases.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "alias"))), 1, most_aliases).alias("a"))
    names = names.select("qid", F.transform("a", lambda x: x["alias"]).alias("aliases"))
    both = entities.join(degrees(triples), "qid", "full").join(names, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.select("qid", F.coalesce("title", "qid").alias("title"), "abstract", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), zero("degree_in"), zero("degree_out"))


def neighbors(triples: DataFrame, titles: DataFrame, labels: DataFrame, qid: str, relation: str | None = None, direction: str = "both", limit: int = 25, offset: int = 0) -> DataFrame:
    """A page of a node's edges in stored direction, with the total. The filter on the node reaches the scans."""
    check_qid(qid)
    bounded("limit", limit)
    if direction not in ("out", "in", "both") or offset < 0:
        raise ValueError("direction must be out, in or both, and offset not negative")
    where = {"out": F.col("src") == qid, "in": F.col("dst") == qid, "both": (F.col("src") == qid) | (F.col("dst") == qid)}[direction]
    found = triples.where(where)
    if relation is not None:
        found = found.where(F.col("rel") == relation)
    ensure_checkpoint_dir(triples.sparkSession)
    found = found.select("src", "rel", "dst").checkpoint()  # the node's own edges: the triples are read once for the total and the page
    total = found.count()
    page = found.orderBy("rel", "dst", "src").offset(offset).limit(limit).collect()  # `limit` rows at most, so titles and labels are asked for by id
    by_id = lambda df, key, value, ids: {r[0]: r[1] for r in df.where(F.col(key).isin(sorted(ids))).groupBy(key).agg(F.min(value)).collect()} if ids else {}
    title = by_id(titles, "qid", "title", {r.dst for r in page})
    label = by_id(labels, "pid", "label", {r.rel for r in page})
    rows = [(total, r.src, r.rel, label.get(r.rel) or r.rel, r.dst, title.get(r.dst) or r.dst) for r in page]
    return triples.sparkSession.createDataFrame(rows, "total long, src string, rel string, rel_label string, dst string, dst_title string")


def hop(triples: DataFrame, anchors: DataFrame, seed: int = 0, pool: int = 25) -> DataFrame:
    """One outgoing edge of each anchor (qid), among its first ``pool`` by (rel, dst), by a seeded hash."""
    out = anchors.join(triples, F.col("qid") == F.col("src"))
    first = Window.partitionBy("qid").orderBy("rel", "dst")
    near = out.withColumn("n", F.row_number().over(first)).where(F.col("n") <= pool)
    return near.groupBy("qid").agg(F.min_by(F.struct("rel", "dst"), seeded(seed, F.col("qid"), F.col("rel"), F.col("dst"))).alias("x")).select("qid", "x.rel", "x.dst")


def linked_pairs(triples: DataFrame) -> DataFrame:
    """Distinct undirected pairs (lo, hi)."""
    return triples.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()


def common_neighbors(triples: DataFrame, a: str, b: str) -> DataFrame:
    """Nodes that neighbour both a and b, in any direction."""
    near = lambda q: triples.where(F.col("src") == q).select(F.col("dst").alias("qid")).union(triples.where(F.col("dst") == q).select("src"))
    return near(a).intersect(near(b))


def shortest_paths(triples: DataFrame, pairs: DataFrame, max_hops: int = 3, limit: int = 10) -> DataFrame:
    """All shortest undirected paths of each pair (s, t), up to max_hops edges; at most ``limit`` a pair, by their text.

    A breadth-first search from both ends in turn over distinct (pair, node) with hop counts: a hub is one row a pair however
    many walks lead through it. A pair ends where the two fronts meet. Then the paths are rebuilt from t back to s over
    nodes of the right hop count alone; paths that begin at one node keep their order when they grow at the front, so
    ``limit`` a pair and node lose none. Levels are checkpointed, so plans don't grow, and edges are read once.
    Parallel edges give separate paths. Result: s, t, length, path; path is node text with '-rel>' or '<rel-' between.
    """
    bounded("max_hops", max_hops)
    bounded("paths", limit)
    ensure_checkpoint_dir(triples.sparkSession)
    step = triples.select(F.col("src").alias("u"), F.concat(F.lit("-"), "rel", F.lit(">")).alias("label"), F.col("dst").alias("v"))
    step = step.union(triples.where("src <> dst").select("dst", F.concat(F.lit("<"), "rel", F.lit("-")), "src")).checkpoint()
    pairs = pairs.where("s <> t").distinct()
    front = [pairs.select("s", "t", F.col(end).alias("at"), F.lit(0).alias("hops")) for end in ("s", "t")]
    reached, depth, open_, solved = list(front), [0, 0], pairs, []
    for length in range(1, max_hops + 1):
        i = (length + 1) % 2
        depth[i] += 1
        grown = front[i].join(open_, ["s", "t"], "left_semi").join(step, F.col("at") == F.col("u")).select("s", "t", F.col("v").alias("at")).distinct()
        front[i] = grown.join(reached[i].select("s", "t", "at"), ["s", "t", "at"], "left_anti").withColumn("hops", F.lit(depth[i])).checkpoint()
        reached[i] = reached[i].union(front[i])
        met = front[i].join(front[1 - i].select("s", "t", "at"), ["s", "t", "at"], "left_semi").select("s", "t").distinct()
        solved.append(met.withColumn("length", F.lit(length)))
        open_ = open_.join(met, ["s", "t"], "left_anti")
    # From t back to s: position p of a path of length n is a node p hops from s up to the meeting, n - p hops from t beyond it.
    levels = reached[0].withColumn("side", F.lit(0)).union(reached[1].withColumn("side", F.lit(1)))
    levels = levels.select(F.col("s").alias("s2"), F.col("t").alias("t2"), F.col("at").alias("at2"), F.col("hops").alias("hops2"), "side")
    partial = reduce(DataFrame.union, solved).select("s", "t", "length", F.col("t").alias("at"), F.col("t").alias("path"))
    found = []
    for back in range(1, max_hops + 1):
        place = F.col("length") - back
        near = place <= F.floor((F.col("length") + 1) / 2)
        grown = partial.where(F.col("length") >= back).join(step, F.col("at") == F.col("v"))
        grown = grown.select("s", "t", "length", F.col("u").alias("at"), F.concat("u", "label", "path").alias("path"), F.when(near, place).otherwise(back).alias("hops"), F.when(near, 0).otherwise(1).alias("want"))
        on = (F.col("s") == F.col("s2")) & (F.col("t") == F.col("t2")) & (F.col("at") == F.col("at2")) & (F.col("hops") == F.col("hops2")) & (F.col("want") == F.col("side"))
        first = Window.partitionBy("s", "t", "at").orderBy("path")
        grown = grown.join(levels, on, "left_semi").withColumn("n", F.row_number().over(first)).where(F.col("n") <= limit)
        partial = grown.select("s", "t", "length", "at", "path").checkpoint()
        found.append(partial.where(F.col("length") == back))
    return reduce(DataFrame.union, found).select("s", "t", F.col("length").cast("long").alias("length"), "path")


def path_parts(paths: DataFrame, titles: DataFrame, labels: DataFrame) -> DataFrame:
    """Paths with ``nodes`` [(qid, title)] and ``edges`` [(src, rel, rel_label, dst)] in stored direction, in order.

    A node without a title is titled by its id, a relation without a label by its own.
    """
    nodes = paths.select("path").distinct().select("path", F.posexplode(F.regexp_extract_all("path", F.lit("(Q[0-9]+)"), F.lit(1))).alias("pos", "qid"))
    known = titles.select("qid", "title").join(F.broadcast(nodes.select("qid").distinct()), "qid").groupBy("qid").agg(F.min("title").alias("title"))  # ids of ``limit`` paths a pair
    named = nodes.join(known, "qid", "left").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "qid", F.coalesce("title", "qid").alias("title")))).alias("x"))
    named = named.select("path", F.transform("x", lambda x: F.struct(x["qid"].alias("qid"), x["title"].alias("title"))).alias("nodes"))
    hops = F.regexp_extract_all("path", F.lit("([-<]P[0-9]+[->])"), F.lit(1))
    edges = named.select("path", F.col("nodes.qid").alias("ids"), F.posexplode(hops).alias("pos", "hop"))
    left, right = F.get("ids", F.col("pos")), F.get("ids", F.col("pos") + 1)
    forth = F.col("hop").startswith("-")
    edges = edges.select("path", "pos", F.when(forth, left).otherwise(right).alias("src"), F.regexp_extract("hop", "P[0-9]+", 0).alias("rel"), F.when(forth, right).otherwise(left).alias("dst"))
    edges = edges.join(labels, F.col("rel") == F.col("pid"), "left").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "src", "rel", F.coalesce("label", "rel").alias("rel_label"), "dst"))).alias("x"))
    edges = edges.select(F.col("path").alias("path2"), F.transform("x", lambda x: F.struct(x["src"].alias("src"), x["rel"].alias("rel"), x["rel_label"].alias("rel_label"), x["dst"].alias("dst"))).alias("edges"))
    return paths.join(named, "path").join(edges, F.col("path") == F.col("path2")).drop("path2")


def valid_edge(src: Column, rel: Column, dst: Column) -> Column:
    return valid_qid(src) & valid_pid(rel) & valid_qid(dst)
