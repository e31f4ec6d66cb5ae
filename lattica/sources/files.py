"""Sources and sinks: ragged text tables, JSON lines (strict, tolerant, resumable), reports, CSV exports, manifests."""

from __future__ import annotations

import json
import os
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lattica.functions.ids import clean_qids, valid_qid

QUESTION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer_qids", T.ArrayType(T.StringType())),
        T.StructField("bridge_qids", T.ArrayType(T.StringType())),
        T.StructField("source", T.StringType()),
        T.StructField("cypher", T.StringType()),
        T.StructField("difficulty", T.IntegerType()),
    ]
)
SOURCES = ("kg_pattern", "sim_link", "frames")


def download(url: str, path: str) -> bool:
    """Fetches a file unless it is there; it appears whole or not at all. True if it was fetched."""
    if os.path.exists(path) and os.path.getsize(path):
        return False
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    urllib.request.urlretrieve(url, f"{path}.part")
    os.replace(f"{path}.part", path)
    return True


def verify_lines(spark: SparkSession, minimums: dict[str, int]) -> DataFrame:
    """(path, lines, least, ok) of text files; a missing file has 0 lines."""
    rows = []
    for path, least in sorted(minimums.items()):
        try:
            lines = spark.read.text(path).count()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            lines = 0
        rows.append((path, lines, least, lines >= least))
    return spark.createDataFrame(rows, "path string, lines long, least long, ok boolean")


def read_ragged(spark: SparkSession, path: str) -> DataFrame:
    """(qid, values ARRAY, line) of tab-separated lines of any width; ``line`` orders them by file and place; blank lines are skipped."""
    cells = F.split("value", "\t", -1)
    lines = spark.read.text(path)
    return lines.withColumn("line", by_line(lines)).where(F.trim("value") != "").select(cells[0].alias("qid"), F.slice(cells, F.lit(2), F.greatest(F.lit(0), F.size(cells) - 1)).alias("values"), "line")


def by_line(rows: DataFrame) -> Column:
    """What a line's place is: its file's path, then its place in the file.

    Row ids grow within a partition, and a file's partitions are numbered by offset only within one scan, so the offset of the
    split comes between.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))


def dataset(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Rows of a dataset from Parquet, JSON lines or CSV with a header, by the ending of the path; Parquet without one."""
    name = path.rstrip("/").lower()
    if name.endswith((".json", ".jsonl", ".ndjson")):
        rows = spark.read.json(path)
    elif name.endswith((".csv", ".tsv")):
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", "\t" if name.endswith("tsv") else ",").csv(path)
    else:
        rows = spark.read.parquet(path)
    return rows.limit(limit) if limit is not None else rows


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(qid, abstract): the other cells of a line are one text, its tabs kept; the last row of a qid wins."""
    rows = read_ragged(spark, path).select("qid", F.array_join("values", "\t").alias("abstract"), "line")
    return rows.groupBy("qid").agg(F.max_by("abstract", "line").alias("abstract"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(qid, pos, alias); repeats are kept."""
    return read_ragged(spark, path).select("qid", F.posexplode("values").alias("pos", "alias"))


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """(pid, label): the first non-empty alias; the first row of a pid wins."""
    rows = read_ragged(spark, path).select(F.col("qid").alias("pid"), F.try_element_at(F.filter("values", lambda x: x != ""), F.lit(1)).alias("label"), "line")
    return rows.where("label is not null").groupBy("pid").agg(F.min_by("label", "line").alias("label"))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(src, rel, dst) of lines of exactly three cells; others are dropped."""
    cells = F.split("value", "\t", -1)
    return spark.read.text(path).where(F.size(cells) == 3).select(cells[0].alias("src"), cells[1].alias("rel"), cells[2].alias("dst"))


def question_problems() -> Column:
    """What is wrong with a question record; null if nothing."""
    bad = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda q: ~valid_qid(q))
    return (
        F.when(F.col("id").isNull() | F.col("question").isNull(), "no id or question")
        .when(bad(F.col("answer_qids")) | bad(F.col("bridge_qids")), "bad qid")
        .when(~F.coalesce(F.col("source"), F.lit("")).isin(*SOURCES), "bad source")
        .when(F.coalesce(F.col("difficulty"), F.lit(0)) < 1, "bad difficulty")
    )


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question records, strictly: a broken line or an invalid record raises; qid lists lose repeats."""
    rows = spark.read.schema(QUESTION).option("mode", "FAILFAST").json(path)
    problem = question_problems()
    checked = F.when(problem.isNull(), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("invalid question: "), problem)))
    return rows.withColumn("id", checked).withColumn("answer_qids", clean_qids(F.col("answer_qids"))).withColumn("bridge_qids", clean_qids(F.coalesce("bridge_qids", F.array().cast("array<string>"))))


def read_questions_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """Records of *.jsonl files that parse and have id, question and answers; of an id the first by file name and line."""
    schema = "id string, question string, answer_qids array<string>, bridge_qids array<string>, source string, cypher string, difficulty string"
    lines = spark.read.text(f"{path}/*.jsonl").withColumn("line", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))).select("value", "line")
    rows = lines.where(F.trim("value") != "").select(F.from_json("value", schema).alias("r"), "line")
    good = rows.where("r.id is not null and r.id <> '' and r.question <> '' and size(r.answer_qids) > 0")
    first = Window.partitionBy("r.id").orderBy("line")
    return good.withColumn("n", F.row_number().over(first)).where("n = 1").select("r.*")


def resume_counts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ids done, counts by difficulty) of a JSON-lines file whose last line may be torn; none if it is missing."""
    try:
        rows = spark.read.text(path).select(F.from_json("value", "id string, difficulty int").alias("r")).select("r.*").where("id is not null").dropDuplicates(["id"])
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], "id string, difficulty int")
    return rows.select("id"), rows.groupBy("difficulty").agg(F.count("*").alias("n"))


def append_records(records: DataFrame, path: str) -> None:
    """Appends JSON lines; null fields are left out."""
    records.write.mode("append").option("ignoreNullFields", True).json(path)


def append_new(records: DataFrame, path: str) -> DataFrame:
    """Appends the records whose id isn't there yet, and returns them as they were before the write."""
    done, _ = resume_counts(records.sparkSession, f"{path}/*.json")
    new = records.dropDuplicates(["id"]).join(done, "id", "left_anti")
    append_records(new, path)
    return new


def write_report(report: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_nested(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge CSVs with the header names of a bulk importer."""
    nodes.select(F.col("qid").alias("qid:ID"), "title").write.mode("overwrite").option("header", True).csv(f"{path}/nodes")
    edges.select(F.col("src").alias(":START_ID"), "rel", F.col("rel_label").alias("label"), F.col("dst").alias(":END_ID")).write.mode("overwrite").option("header", True).csv(f"{path}/edges")


def publish_graph(triples: DataFrame, path: str) -> DataFrame:
    """Triples as Parquet by relation, so that a filter on rel reads its folder alone; returns counts by relation."""
    triples.repartition("rel", F.pmod(F.xxhash64("src"), F.lit(16))).sortWithinPartitions("src").write.mode("overwrite").partitionBy("rel").parquet(path)
    return triples.sparkSession.read.parquet(path).groupBy("rel").agg(F.count("*").alias("n"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def status(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of each table."""
    from functools import reduce

    return reduce(DataFrame.union, [df.agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name, df in sorted(tables.items())])


def load_config(path: str, known: tuple[str, ...]) -> dict:
    """Known keys of a JSON file of settings; others are ignored, and a missing file is no settings."""
    if not os.path.exists(path):
        return {}
    with open(path) as f:
        return {k: v for k, v in json.load(f).items() if k in known}
