"""Splits, curricula, nested rows, files, manifests and the incremental stream."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import functions as F

from lattica.functions import ids
from lattica.operators import graph, splits, vectors
from lattica.plans import triples as T
from lattica.session import ensure_checkpoint_dir, table
from lattica.sources import files
from lattica.streaming import incremental

WORDS = ("trivial", "easy", "medium", "hard", "very_hard", "odd")


def folder(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"



def records(spark, sf_dir):
    """A question of every order."""
    k = F.col("o_orderkey")
    word = F.element_at(F.array(*map(F.lit, WORDS)), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("kg-"), k.cast("string")).alias("id"), F.concat(F.lit("Which "), k.cast("string"), F.lit("?")).alias("question"), F.array(T.qid(T.CUSTOMER, F.col("o_custkey"))).alias("answers"),
        F.array(T.qid(T.ORDER, k)).alias("bridges"), F.lit("kg_pattern").alias("source"), word.alias("difficulty"), ids.difficulty_rank(word).alias("rank"),
    )


def hash_split_counts(spark, sf_dir):
    return splits.split(records(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def validation_set(spark, sf_dir):
    return splits.validation(records(spark, sf_dir), 0.2, 100).select("id", "split")


def ordered(spark, sf_dir, kind):
    return splits.curriculum(records(spark, sf_dir), kind, seed=2).select("place", "id", "rank")


def quota_draw(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("difficulty", (F.col("rank") + 1).cast("int"))
    return splits.quota(rows, {1: 0.1, 2: 0.3, 3: 0.4, 4: 0.2}, 200, seed=4).select("id", F.col("difficulty").cast("long").alias("difficulty"))


def rl_rows(spark, sf_dir):
    train = splits.split(splits.curriculum(records(spark, sf_dir), "sorted", seed=2))
    rows = splits.rl_rows(train, "Answer with ids.")
    return rows.select("data_source", F.to_json("prompt").alias("prompt"), F.col("reward_model.ground_truth").alias("truth"), "extra_info.index", "extra_info.split", "extra_info.id", F.to_json("extra_info.tools_kwargs").alias("tools"))


def status_counts(spark, sf_dir):
    return files.status({n: table(spark, sf_dir, n) for n in ("nation", "region", "customer", "orders", "documents", "embeddings")} | {"triple": T.triples(spark, sf_dir)})


def keyset_page(spark, sf_dir):
    """The page of entities after a given id, in text order."""
    return T.entities(spark, sf_dir).where("qid > 'Q3000000123'").orderBy("qid").limit(40).select("qid", "title")


def offset_page(spark, sf_dir):
    return T.entities(spark, sf_dir).orderBy("qid").offset(30).limit(20).select("qid", "title")


def upsert_latest(spark, sf_dir):
    """Two versions of points, upserted by id."""
    old = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.lit(1).alias("version"))
    new = old.where("id % 3 = 0").select("id", (F.col("label") + 100).alias("label"), F.lit(2).alias("version"))
    return vectors.upsert(old, new).select("id", "label")


def jsonl_tolerant(spark, sf_dir):
    """Records with broken, incomplete and repeated lines among them, written as text and loaded."""
    path = folder(spark)
    rows = records(spark, sf_dir).select(F.to_json(F.struct("id", "question", F.col("answers").alias("answer_qids"), "source", "difficulty")).alias("value"))
    rows.write.text(f"{path}/raw")
    lines = spark.read.text(f"{path}/raw")
    lines.union(lines).union(spark.createDataFrame([("{broken",), ('{"id": "x"}',), ("",)], "value string")).write.option("compression", "none").text(f"{path}/text")
    got = files.read_questions_tolerant(spark, _as_jsonl(spark, f"{path}/text"))
    return got.select("id", "question", F.array_join("answer_qids", ",").alias("answers"))


def _as_jsonl(spark, path: str) -> str:
    """Renames a folder's part files to *.jsonl."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.listStatus(at):
        name = s.getPath().getName()
        if name.startswith("part-"):
            fs.rename(s.getPath(), jvm.org.apache.hadoop.fs.Path(at, name.rsplit(".", 1)[0] + ".jsonl"))
    return path


def jsonl_append(spark, sf_dir):
    """Records appended in two overlapping goes; ids that are there aren't written again."""
    path = folder(spark)
    rows = records(spark, sf_dir).select("id", "question", F.lit(None).cast("string").alias("cypher"), (F.col("rank") + 1).cast("int").alias("difficulty"))
    files.append_records(rows.where("rank < 2"), path)
    files.append_new(rows.where("rank < 4"), path)
    done, counts = files.resume_counts(spark, f"{path}/*.json")
    return counts.select(F.col("difficulty").cast("long").alias("difficulty"), "n")


def ragged_load(spark, sf_dir):
    """Aliases and texts as tab-separated lines, loaded again."""
    path = folder(spark)
    part = table(spark, sf_dir, "part")
    q = T.qid(T.PART, F.col("p_partkey"))
    part.select(F.concat_ws("\t", q, "p_name", "p_brand")).write.text(f"{path}/alias")
    part.select(F.concat_ws("\t", q, F.concat(F.lit('a "'), "p_name", F.lit('"\tb')))).write.text(f"{path}/text")
    names = files.read_aliases(spark, f"{path}/alias").groupBy("qid").agg(F.count("*").alias("n"), F.max_by("alias", "pos").alias("last"))
    return files.read_texts(spark, f"{path}/text").join(names, "qid").select("qid", "abstract", "n", "last")


def triple_files(spark, sf_dir):
    """Triples as lines with broken ones among them, loaded, published by relation and counted."""
    path = folder(spark)
    lines = T.triples(spark, sf_dir).select(F.concat_ws("\t", "src", "rel", "dst").alias("value"))
    lines.union(spark.createDataFrame([("a\tb",), ("a\tb\tc\td",), ("",)], "value string")).write.text(f"{path}/lines")
    return files.publish_graph(files.read_triples(spark, f"{path}/lines"), f"{path}/graph")


def graph_export(spark, sf_dir):
    """Nodes and edges as CSV; what is read back."""
    path = folder(spark)
    nodes = graph.node_set(T.entities(spark, sf_dir), T.triples(spark, sf_dir))
    files.export_graph(nodes, graph.label_edges(T.triples(spark, sf_dir), T.relation_labels(spark)), path)
    read = lambda name: spark.read.option("header", True).csv(f"{path}/{name}")
    return read("nodes").agg(F.lit("nodes").alias("kind"), F.count("*").alias("n"), F.min("`qid:ID`").alias("first")).union(read("edges").agg(F.lit("edges"), F.count("*"), F.min("`:START_ID`")))


def manifest_checksums(spark, sf_dir):
    """Sizes and checksums of a table's files as they lie there."""
    return files.manifest(spark, f"{sf_dir}/nation.parquet")


def incremental_embed_text(spark, sf_dir):
    """Entities that arrive in two goes, the second with newer versions; the index after both."""
    path = folder(spark)
    rows = T.entities(spark, sf_dir).withColumn("version", F.lit(1).cast("long"))
    for go in (rows.where("qid < 'Q3000000500'"), rows.where("qid > 'Q3000000400'").withColumn("version", F.lit(2).cast("long")).withColumn("title", F.concat("title", F.lit("*")))):
        go.write.mode("append").parquet(f"{path}/in")
        incremental.run_available(spark, f"{path}/in", f"{path}/index", f"{path}/state")
    return incremental.current(spark, f"{path}/index").select("qid", F.sha2("doc_text", 256).alias("doc_text"), "version")


RECORDS = {
    "hash_split_counts": hash_split_counts,
    "validation_set": validation_set,
    "curriculum_off": partial(ordered, kind="off"),
    "curriculum_sorted": partial(ordered, kind="sorted"),
    "curriculum_mixed": partial(ordered, kind="mixed"),
    "quota_draw": quota_draw,
    "rl_rows": rl_rows,
    "jsonl_tolerant_load": jsonl_tolerant,
    "jsonl_append_resume": jsonl_append,
}
QUERIES = {
    **RECORDS,
    "status_counts": status_counts,
    "keyset_page": keyset_page,
    "offset_page": offset_page,
    "upsert_latest": upsert_latest,
    "ragged_load": ragged_load,
    "triple_files": triple_files,
    "graph_export": graph_export,
    "manifest_checksums": manifest_checksums,
    "incremental_embed_text": incremental_embed_text,
}
_R = "r AS (SELECT 'kg-' || o_orderkey AS id, o_orderkey AS k, o_custkey, [0.0, 1.0, 2.0, 3.0, 4.0, 2.0][o_orderkey % 6 + 1]::DOUBLE AS rank, ['trivial', 'easy', 'medium', 'hard', 'very_hard', 'odd'][o_orderkey % 6 + 1] AS difficulty FROM orders), s AS (SELECT *, CASE WHEN CAST('0x' || left(sha256(id), 16) AS UBIGINT)::DOUBLE / 18446744073709551616.0 < {f} THEN 'val' ELSE 'train' END AS split, sha256('2|' || id) AS h FROM r)"


def _place(order: str) -> str:
    return f"WITH {_R.replace('{f}', '0.05')}, t AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY h, id) AS turn FROM s) SELECT row_number() OVER (ORDER BY {order}) - 1 AS place, id, rank FROM t"


ORACLES = {
    "hash_split_counts": f"WITH {_R.replace('{f}', '0.05')} SELECT split, count(*) AS n, min(id) AS first FROM s GROUP BY 1",
    "validation_set": f"WITH {_R.replace('{f}', '0.2')} SELECT id, split FROM s WHERE split = 'val' ORDER BY id LIMIT 100",
    "curriculum_off": _place("h, id"),
    "curriculum_sorted": _place("rank, h, id"),
    "curriculum_mixed": _place("turn, rank, id"),
    "quota_draw": f"WITH {_R.replace('{f}', '0.05')}, t AS (SELECT id, CAST(rank AS BIGINT) + 1 AS difficulty, row_number() OVER (PARTITION BY rank ORDER BY sha256('4|' || id), id) AS n FROM s) SELECT id, difficulty FROM t WHERE n <= CASE difficulty WHEN 1 THEN 20 WHEN 2 THEN 60 WHEN 3 THEN 80 WHEN 4 THEN 40 ELSE 0 END",
    "rl_rows": f"""WITH {_R.replace('{f}', '0.05')} SELECT 'retrieval/kg_pattern' AS data_source, '[{{"role":"system","content":"Answer with ids."}},{{"role":"user","content":"Which ' || k || '?"}}]' AS prompt,
'{{"answer_qids":["Q' || (3000000000 + o_custkey) || '"],"bridge_qids":["Q' || (6000000000 + k) || '"]}}' AS truth, row_number() OVER (ORDER BY rank, h, id) - 1 AS index, split, id,
'{{' || array_to_string(['"' || t || '":{{"create_kwargs":{{"question_id":"' || id || '"}}}}' FOR t IN ['vector_search', 'get_entity', 'get_neighbors', 'find_paths']], ',') || '}}' AS tools FROM s""",
    "status_counts": f"WITH {T.TRIPLE_CTE} " + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in ("nation", "region", "customer", "orders", "documents", "embeddings", "triple")),
    "keyset_page": f"WITH {T.ENTITY_CTE} SELECT qid, title FROM entity WHERE qid > 'Q3000000123' ORDER BY qid LIMIT 40",
    "offset_page": f"WITH {T.ENTITY_CTE} SELECT qid, title FROM entity ORDER BY qid LIMIT 20 OFFSET 30",
    "upsert_latest": "SELECT vec_id AS id, CAST(label AS BIGINT) + CASE WHEN vec_id % 3 = 0 THEN 100 ELSE 0 END AS label FROM embeddings",
    "jsonl_tolerant_load": f"WITH {_R.replace('{f}', '0.05')} SELECT id, 'Which ' || k || '?' AS question, 'Q' || (3000000000 + o_custkey) AS answers FROM s",
    "jsonl_append_resume": f"WITH {_R.replace('{f}', '0.05')} SELECT CAST(rank AS BIGINT) + 1 AS difficulty, count(*) AS n FROM s WHERE rank < 4 GROUP BY 1",
    "ragged_load": "SELECT 'Q' || (5000000000 + p_partkey) AS qid, 'a \"' || p_name || '\"' || chr(9) || 'b' AS abstract, CAST(2 AS BIGINT) AS n, p_brand AS last FROM part",
    "triple_files": f"WITH {T.TRIPLE_CTE} SELECT rel, count(*) AS n FROM triple GROUP BY 1",
    "graph_export": f"WITH {T.TRIPLE_CTE}, {T.ENTITY_CTE}, n AS (SELECT qid FROM entity UNION SELECT src FROM triple UNION SELECT dst FROM triple) SELECT 'nodes' AS kind, count(*) AS n, min(qid) AS first FROM n UNION ALL SELECT 'edges', count(*), min(src) FROM triple",
    "incremental_embed_text": f"""WITH {T.ENTITY_CTE}, e AS (SELECT qid, CASE WHEN qid > 'Q3000000400' THEN title || '*' ELSE title END AS title, trim(regexp_replace(coalesce(abstract, ''), '[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'), ' ') AS t, CASE WHEN qid > 'Q3000000400' THEN 2 ELSE 1 END AS v FROM entity)
SELECT qid, sha256(title || '. ' || array_to_string(string_split(t, ' ')[1:400], ' ')) AS doc_text, CAST(v AS BIGINT) AS version FROM e""",
}
