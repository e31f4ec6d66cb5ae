"""Line dedup: range-partitioned line hashes with a secondary sort, answered as compressed keep bitmaps.

Every line becomes a 128-bit hash of its key (the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
lower-cased), its document and its position. The hashes are range-partitioned and sorted by document and
position within a hash; one streaming pass over that order marks where a key meets a document for the first
time. A hash is salted by its document inside the range key, so one very common line spreads over many
partitions; the marks are then summed with map-side combine. No text is shuffled for the decision: a document
gets a bitmap of 64-line words, and words without a dropped line are left out of it.

Everything is DataFrame functions. Cases: null or empty text is one empty line; keys shorter than ``min_chars``
are never dropped; rows are told apart by doc_id (null is an id of its own) and text, so equal repeated rows get
equal answers and count as one document; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.session import ensure_checkpoint_dir, table

WS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 1 << 16


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep: str = "none", min_chars: int = 1) -> DataFrame:
    """Per document with a dropped line: d, t (xxhash64 of the text), n_dropped, and words ARRAY<STRUCT<word, bits>>.

    Bit ``p % 64`` of word ``p div 64`` is set where line p goes; words that aren't listed keep all their lines.
    keep = "none": keys found in at least ``min_docs`` documents lose all their lines.
    keep = "first": such keys keep their first line by (doc_id, position).
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be 'none' or 'first', not {keep!r}")
    ensure_checkpoint_dir(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), _lines(ascii_lower(F.col("text"))).alias("lines"))  # the text's hash is taken below the explode
    occurrences = (
        split.select("d", "t", F.posexplode("lines").alias("p", "line"))
        .select("d", "t", "p", F.btrim("line", F.lit(WS)).alias("k"))
        .where(F.char_length("k") >= min_chars)
        .select(F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"), F.pmod(F.hash("d"), F.lit(SALTS)).alias("salt"), "d", "t", "p")
        .checkpoint()  # texts are split once; the range sampling and both uses of the hashes read them from here
    )
    ranged = occurrences.repartitionByRange(n, "h1", "h2", "salt")
    run = Window.partitionBy("h1", "h2", "salt").orderBy("d", "t", "p")
    marks = ranged.select("h1", "h2", "d", "t", "p", ((F.row_number().over(run) == 1) | ~F.col("d").eqNullSafe(F.lag("d").over(run))).alias("new"))
    found = (
        marks.where("new")
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n_docs"), F.min(F.struct("d", "t", "p")).alias("first"))
        .where(F.col("n_docs") >= min_docs)
        .checkpoint()  # a join with it can then be split where one key has very many lines
    )
    going = occurrences.select("h1", "h2", "d", "t", "p")
    if keep == "none":
        going = going.join(found.select("h1", "h2"), ["h1", "h2"], "left_semi")
    else:
        going = going.join(found.select("h1", "h2", "first"), ["h1", "h2"]).where(~F.struct("d", "t", "p").eqNullSafe(F.col("first")))
    return (
        going.groupBy("d", "t", F.expr("p div 64").cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, p % 64)")).alias("bits"))
        .groupBy("d", "t")
        .agg(F.sum(F.bit_count("bits")).alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every row of docs."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("t_"))
    joined = rows.join(bitmaps, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t_") == F.col("t")), "left")
    # Every array is made once for a document, so the work is linear in its lines: zeros fill the gaps between listed words.
    dense = "flatten(transform(words, (x, k) -> concat(array_repeat(0L, x.word - coalesce(get(words, k - 1).word, -1) - 1), array(x.bits))))"
    going = f"flatten(transform({dense}, b -> transform(sequence(0, 63), j -> (shiftright(b, j) & 1L) = 1L)))"
    kept = F.expr(f"array_join(zip_with(lines, {going}, (x, gone) -> if(coalesce(gone, false), null, x)), '\n')")
    cut = joined.withColumn("lines", _lines(F.col("text")))
    return cut.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("words").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept_text"),
    )


def line_dedup(docs: DataFrame, min_docs: int = 10, keep: str = "none", min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text of every row."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_docs, keep, min_chars))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose key is in at least 10 documents go everywhere; a digest of what stays."""
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = """
WITH l AS (
  SELECT doc_id, p, s AS line,
         trim(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT doc_id, unnest(ls) AS s, unnest(range(len(ls))) AS p
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), f AS (
  SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT l.doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.p) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY l.doc_id
"""
