"""Token ids as binary shards: byte-level BPE, the adaptive range coder of rangecoder.py, and a reader.

Documents are range-partitioned and sorted by doc_id, encoded, and packed into shards of whole documents (SHARD ids or
more each). A shard is one row of a Parquet table that Spark writes (so attempts that are lost leave nothing):
part (range) and seq (place within it) give the order; ``shard`` holds the bytes below, which stand by themselves.

    magic 'LTS2' | version u16 | block u16 | documents u32 | ids u64 | blocks u32 | prior's bytes u32 | CRC-32 of these u32
    doc_ids i64 x documents, null flags u8 x documents, lengths u32 x documents, CRC-32 of these u32
    the coder's prior, CRC-32 of it u32
    bytes u32 and CRC-32 u32 of each block, CRC-32 of these u32
    the blocks' bytes, each decodable from its own start (little-endian throughout)

Ids before a document come from prefix sums over shards, two levels deep; only one row a range meets in one task.

Cases: null text is empty and gets the end id alone; null doc_ids come first; rows that repeat a doc_id follow each other,
ordered by a hash of the text; the strings of special tokens in a text are ordinary text; doc_id must be integer;
other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm import rangecoder
from lattica.llm._text import limits, release, tidy
from lattica.session import ensure_checkpoint_dir, ship, table

END, SHARD = 2, 6_000_000
#: Words whose ids a worker remembers, in each of two generations.
MEMO = 250_000
#: Words that go to the library at a time.
RUN = 64
HEAD = struct.Struct("<4sHHIQII")


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: printable Latin-1 itself, others from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [i for i in range(256) if i not in own]
    return {i: chr(i) for i in own} | {i: chr(256 + k) for k, i in enumerate(rest)}


class Encoder:
    """Ids of texts as little-endian 16-bit bytes, equal to the library's own; words seen before come from a memo.

    A byte-level BPE splits before a space between two other characters, so a text is the sum of its space-separated words. A
    text with any other use of white space next to a space goes to the library whole. New words go to it RUN at a time, as one
    text, and their ids part where a piece begins with a space.
    The memo has two generations; when the younger is full, what it hasn't met since goes.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        space = byte_letters()[32]
        self.begins = np.zeros(1 << 16, bool)
        self.begins[[i for piece, i in self.tokenizer.get_vocab().items() if piece[:1] == space]] = True
        self.memo: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, words: list[str]) -> list[bytes]:
        """Ids of words that begin with their only space."""
        out: list[bytes] = []
        for at in range(0, len(words), 64 * RUN):
            runs = [words[i : i + RUN] for i in range(at, min(at + 64 * RUN, len(words)), RUN)]
            for run, raw in zip(runs, self._ids(["".join(r) for r in runs])):
                cut = (np.flatnonzero(self.begins[np.frombuffer(raw, "<u2")]) * 2).tolist()
                out += map(raw.__getitem__, map(slice, cut, [*cut[1:], len(raw)])) if len(cut) == len(run) else self._ids(run)
        return out

    def _learn(self, words: set[str]) -> None:
        memo, old, runs, rest = self.memo, self.old, [], []
        for w in words:
            if w in old:
                memo[w] = old[w]
                continue
            core = w[1:] if w[:1] == " " else w
            if not core or core.strip() != core:
                memo[w] = None
            elif core is w:
                rest.append(w)
            else:
                runs.append(w)
        memo.update(zip(runs, self._runs(runs)))
        memo.update(zip(rest, self._ids(rest)))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [t.replace(" ", "\0 ").split("\0") if "\0" not in t else [w if not i else f" {w}" for i, w in enumerate(t.split(" "))] for t in texts]
        need = set().union(*cut)
        new = need - self.memo.keys()
        if len(self.memo) + len(new) > MEMO:
            self.memo, self.old, new = {}, self.memo, need
        self._learn(new)
        out = []
        for text, words in zip(texts, cut):
            try:
                out.append(b"".join(map(self.memo.__getitem__, words)))
            except TypeError:
                out.append(self._ids([text])[0] if text else b"")
        return out


def pack(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """The bytes of a shard."""
    block = rangecoder.block_size(len(ids))
    prior = rangecoder.Prior.of(ids) if len(ids) else None
    blocks = rangecoder.encode(ids, prior, block) if len(ids) else []
    start = prior.pack() if prior else b""
    head = HEAD.pack(b"LTS2", 2, block, len(doc_ids), len(ids), len(blocks), len(start))
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes() + np.array(lengths, "<u4").tobytes()
    index = np.array([(len(b), zlib.crc32(b)) for b in blocks], "<u4").tobytes()
    return b"".join(x + struct.pack("<I", zlib.crc32(x)) for x in (head, docs, start, index)) + b"".join(blocks)


def unpack(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a shard; raises ValueError where a checksum fails."""

    def part(at: int, n: int) -> tuple[bytes, int]:
        x = data[at : at + n]
        if len(x) < n or data[at + n : at + n + 4] != struct.pack("<I", zlib.crc32(x)):
            raise ValueError("shard is damaged")
        return x, at + n + 4

    head, at = part(0, HEAD.size)
    magic, version, block, n_docs, n_ids, n_blocks, n_prior = HEAD.unpack(head)
    if magic != b"LTS2" or version != 2:
        raise ValueError("not a shard of this format")
    docs, at = part(at, n_docs * 13)
    start, at = part(at, n_prior)
    index, at = part(at, n_blocks * 8)
    blocks = []
    for size, crc in np.frombuffer(index, "<u4").reshape(-1, 2).tolist():
        blocks.append(data[at : at + size])
        at += size
        if zlib.crc32(blocks[-1]) != crc:
            raise ValueError(f"block {len(blocks) - 1} is damaged")
    nulls = np.frombuffer(docs, "u1", n_docs, n_docs * 8)
    doc_ids = [None if z else d for d, z in zip(np.frombuffer(docs, "<i8", n_docs).tolist(), nulls)]
    return doc_ids, np.frombuffer(docs, "<u4", n_docs, n_docs * 9).astype(np.int64), rangecoder.decode(blocks, n_ids, rangecoder.Prior.unpack(start), block) if n_ids else np.zeros(0, np.uint16)


def _write(batches: Iterable[pa.RecordBatch], vocab: str, shard: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encoder, part, seq = Encoder(vocab), TaskContext.get().partitionId(), 0
    docs, lengths, ids, held = [], [], [], 0

    def close() -> pa.RecordBatch:
        nonlocal seq, docs, lengths, ids, held
        ids[:] = [b"".join(ids)]
        release()  # what tokenising left, before the coder takes its own
        data = pack(docs, lengths, np.frombuffer(ids[0], "<u2"))
        row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()), pa.array([data], pa.binary())], names=["part", "seq", "n_ids", "shard"])
        seq, docs, lengths, ids, held = seq + 1, [], [], [], 0
        return row

    end = np.array([END], "<u2").tobytes()
    for batch in batches:
        for d, x in zip(batch.column("doc_id").to_pylist(), encoder.encode([t or "" for t in batch.column("text").to_pylist()])):
            docs.append(d)
            ids += [x, end]
            lengths.append(len(x) // 2 + 1)
            held += lengths[-1]
            if held >= shard:
                yield close()
    if docs:
        yield close()


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, data in zip(*(batch.column(k) for k in ("part", "seq", "shard"))):
            part, seq = part.as_py(), seq.as_py()
            docs, lengths, ids = unpack(data.as_py())
            before = np.concatenate([[0], np.cumsum(lengths)])
            crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(before[:-1].tolist(), before[1:].tolist())]
            n = len(docs)
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(docs, pa.int64()), pa.array(before[:-1]), pa.array(lengths), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"])


def write_shards(docs: DataFrame, path: str, vocab: str, shard: int = SHARD) -> None:
    """Writes the shards of docs as a Parquet table at path."""
    spark = docs.sparkSession
    ship(spark)
    limits(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(lambda it: tidy(_write(it, vocab, shard)), "part int, seq int, n_ids long, shard binary").write.option("compression", "none").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the shards at path."""
    shards = spark.read.schema("part int, seq int, n_ids long, shard binary").parquet(path)
    sizes = shards.select("part", "seq", "n_ids")
    ranges = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(F.col("part").alias("p"), before.alias("before"))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("within", within).join(ranges, F.col("part") == F.col("p")).select(F.col("part").alias("p"), F.col("seq").alias("s"), (F.col("before") + F.col("within")).alias("first"))
    docs = shards.select("part", "seq", "shard").mapInArrow(lambda it: tidy(_read(it)), "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(starts, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def default_vocab() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def token_output(docs: DataFrame, vocab: str | None = None, path: str | None = None, shard: int = SHARD) -> DataFrame:
    """Writes docs as shards (in the cluster's shared folder unless path is given) and returns what reading them gives."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    path = path or f"{spark.sparkContext.getCheckpointDir()}/token-shards-{uuid.uuid4().hex}"
    write_shards(docs, path, vocab or default_vocab(), shard)
    return read_shards(spark, path)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as shards of token ids, read back."""
    return token_output(table(spark, sf_dir, "documents"))
