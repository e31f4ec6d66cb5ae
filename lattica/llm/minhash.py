"""Near-duplicates by ProbMinHash: weighted shingles, banding, exact verification, classes.

A text's distribution over its five-word shingles (weights: how often each occurs) gives a signature of M registers.
Each shingle is a Poisson process of a rate equal to its weight; each arrival goes to a random register, a register
keeps the shingle whose arrival came first, and a shingle stops once its next arrival is later than every register's
time (early termination). Registers of two texts agree with the probability Jaccard similarity
J_P = sum over common i of 1 / sum_j max(x_j/x_i, y_j/y_i). BANDS bands of ROWS registers make buckets: a pair at 0.8
meets in none of them once in about 14,000.

From buckets to classes, without all pairs of a group and without caps:

1. Texts of equal word sequence are one node (their rows join by a 128-bit hash).
2. In each bucket every node is compared with the bucket's leader; the distinct pairs are verified by exact J_P >=
   THRESHOLD on the whole texts, and the links' connected components are found.
3. What is left are pairs of one bucket in different components. Buckets that hold several components are compared in
   full, in units of two blocks of about BLOCK nodes or BLOCK_BYTES of text; two blocks of a bucket's largest component
   don't meet, and a pair that shares several such buckets is compared in the first only. A matrix product gives J_P exactly where no shingle repeats in a text, else an upper bound
   that prunes. A unit returns only links that join components, so rows stay linear in nodes; they join the components.

Two texts that share a bucket and are linked are thus always in one class. 1 - J_P is only ever replaced by
its exact value; nothing is estimated after the banding.

Cases: a text of fewer than five words, but not none, is one shingle; a text without words (null too) is a class of
its own; rows with a null doc_id have a null class and are kept; rows that repeat a doc_id share one class;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from lattica.llm._text import U, limits, shingles, slices, splitmix, tidy, unused, words
from lattica.llm.components import components
from lattica.session import ensure_checkpoint_dir, ship, table

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
M = BANDS * ROWS
#: Nodes and bytes of text of a block (a longer text is a block of its own share), and shingles in a step of the matrix product.
BLOCK, BLOCK_BYTES, WIDTH = 256, 1 << 20, 4096


def weighted(docs: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with counts."""
    with np.errstate(over="ignore"):
        _, at, n = np.unique(splitmix(h ^ (docs.astype(U) * U(0xD6E8FEB86659FD93))), return_index=True, return_counts=True)
    return docs[at], h[at], n.astype(np.float64)


def signatures(docs: np.ndarray, h: np.ndarray, w: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """ProbMinHash signatures [n, m]: the shingle that arrived first at each register; 0 for documents without any."""
    time, who = np.full(n * m, np.inf), np.zeros(n * m, U)
    t, worst, j = np.zeros(len(h)), np.full(n, np.inf), 0
    while len(h):
        with np.errstate(over="ignore"):
            z = splitmix(h + U((j * 0xA24BAED4963EE407) & (2**64 - 1)))
        t = t - np.log(((z >> U(11)).astype(np.float64) + 1) * 2.0**-53) / w
        on = np.flatnonzero(t < worst[docs])
        docs, h, w, t, z = docs[on], h[on], w[on], t[on], z[on]
        slot = docs * m + (splitmix(z) % U(m)).astype(np.int64)
        np.minimum.at(time, slot, t)
        won = time[slot] == t
        who[slot[won]] = h[won]
        worst = time.reshape(n, m).max(1)
        on = np.flatnonzero(t < worst[docs])
        docs, h, w, t = docs[on], h[on], w[on], t[on]
        j += 1
    return who.reshape(n, m)


def _marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coef = splitmix(np.arange(ROWS, dtype=U) + U(501)) | U(1)
    for batch in batches:
        e1, e2, some, bands = [], [], [], []
        for a, b, data, off in slices(batch.column("text")):
            n = b - a
            _, _, h, first = words(data, off)
            counts = np.diff(first)
            at = np.arange(len(h)) - np.repeat(first[:-1], counts)
            doc = np.repeat(np.arange(n), counts)
            d, s, w = weighted(*shingles(h, first, WORDS))
            sig = signatures(d, s, w, n)
            with np.errstate(over="ignore"):
                for out, salt in ((e1, U(3)), (e2, U(5))):
                    total = counts.astype(U)
                    np.add.at(total, doc, h * (splitmix(at.astype(U) * U(8) + salt) | U(1)))
                    out.append(total)
                bands.append(splitmix((sig.reshape(n, BANDS, ROWS) * coef).sum(2, dtype=U)))
            some.append(counts > 0)
        if not e1:
            continue
        lists = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(bands).ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(np.concatenate(e1).view(np.int64)), pa.array(np.concatenate(e2).view(np.int64)), pa.array(np.concatenate(some)), lists], names=["d", "e1", "e2", "some", "bands"])


def probability_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Exact J_P of two weighted sets with sorted hashes."""
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = wa[ia], wb[ib]
    if (wa == 1).all() and (wb == 1).all():
        return len(ia) / (len(ha) + len(hb) - len(ia))
    only_x, only_y = wa.sum() - x.sum(), wb.sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    above_x = x.sum() - np.cumsum(x) + only_x  # weights of j with a larger ratio, of i itself nothing
    upto_y = np.cumsum(y) + only_y
    return float((1.0 / (above_x / x + upto_y / y)).sum())


def _sets(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's sorted shingle hashes and weights."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b, data, off in slices(column):
        _, _, h, first = words(data, off)
        d, s = shingles(h, first, WORDS)
        order = np.lexsort((s, d))
        d, s = d[order], s[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(s))).astype(np.float64)
        cut = np.searchsorted(d[at], np.arange(b - a + 1))
        out += [(s[at[i:j]], n[i:j]) for i, j in zip(cut[:-1], cut[1:])]
    return out


def _verify(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("ta").dictionary_encode(), batch.column("tb")
        heads, at = _sets(left.dictionary), left.indices.to_numpy(zero_copy_only=False)
        good = [probability_jaccard(*heads[i], *t) >= threshold for i, t in zip(at, _sets(right))]
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good, pa.bool_())) for k in ("a", "b")], names=["a", "b"])


def spanning_links(nodes: list, comps: list, sets: list[tuple[np.ndarray, np.ndarray]], threshold: float, mask: np.ndarray | None = None) -> list[tuple]:
    """Links of at least the threshold that join components, as few as it takes; pairs of one component, or outside the mask, aren't compared.

    Texts without a repeated shingle are compared exactly by one matrix product of all; for the others the product of masses
    on shared shingles bounds J_P from above, and what the bound leaves is compared one by one.
    """
    n = len(nodes)
    comp = np.unique(np.array([str(c) for c in comps]), return_inverse=True)[1]
    h = np.concatenate([s for s, _ in sets])
    size = np.array([len(s) for s, _ in sets])
    plain = np.array([bool((w == 1).all()) for _, w in sets])
    who = np.repeat(np.arange(n), size)
    mass = np.concatenate([w / w.sum() for _, w in sets]).astype(np.float32)
    _, col, times = np.unique(h, return_inverse=True, return_counts=True)
    on = times[col] > 1
    who, mass, col = who[on], mass[on], np.unique(col[on], return_inverse=True)[1]
    order = np.argsort(col, kind="stable")
    who, mass, col = who[order], mass[order], col[order]
    common, bound = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    for start in range(0, int(col[-1]) + 1 if len(col) else 0, WIDTH):
        i, j = np.searchsorted(col, (start, start + WIDTH))
        has = np.zeros((n, WIDTH), np.float32)
        has[who[i:j], col[i:j] - start] = 1
        common += has @ has.T
        if not plain.all():
            has2 = np.zeros((n, WIDTH), np.float32)
            has2[who[i:j], col[i:j] - start] = mass[i:j]
            bound += has2 @ has.T
    exact = common.astype(np.float64)
    both = plain[:, None] & plain[None, :]
    sure = both & (exact >= threshold * (size[:, None] + size[None, :] - exact))
    todo = np.triu(sure | (~both & (np.minimum(bound, bound.T) >= threshold - 1e-4)), 1) & (comp[:, None] != comp[None, :])
    if mask is not None:
        todo &= mask
    root = list(range(int(comp.max()) + 1 if n else 0))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for known in (True, False):  # pairs that the product has decided come first
        for i, j in np.argwhere(todo & (both == known)).tolist():
            a, b = find(comp[i]), find(comp[j])
            if a != b and (known or probability_jaccard(*sets[i], *sets[j]) >= threshold):
                root[a] = b
                links.append((nodes[i], nodes[j]))
    return links


def _first_met(band: int, meets: list[list[dict]]) -> np.ndarray:
    """Whether this band is the first in which two nodes share a bucket that is compared in full, [node, node]."""
    n = len(meets)
    at = np.full((n, BANDS), -1, np.int64)
    there = np.zeros((n, BANDS), bool)
    for i, m in enumerate(meets):
        for x in m:
            at[i, x["band"]], there[i, x["band"]] = x["bh"], True
    out = np.ones((n, n), bool)
    for k in range(band):
        out &= ~((at[:, k][:, None] == at[:, k][None, :]) & there[:, k][:, None] & there[:, k][None, :])
    return out


def _unit(threshold: float, kind: pa.DataType):
    def run(t: pa.Table) -> pa.Table:
        mask = _first_met(t.column("band")[0].as_py(), t.column("meets").to_pylist())
        own, i, j = t.column("own").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
        if i != j:  # pairs within a block belong to its own unit
            mask &= own[:, None] != own[None, :]
        links = spanning_links(t.column("n").to_pylist(), t.column("c").to_pylist(), _sets(t.column("text")), threshold, mask) if mask.any() else []
        return pa.table({"a": pa.array([x for x, _ in links], kind), "b": pa.array([y for _, y in links], kind)})

    return run


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and kept (it is that one) of every row."""
    spark = docs.sparkSession
    ship(spark)
    limits(spark)
    ensure_checkpoint_dir(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow = to_arrow_type(docs.schema["doc_id"].dataType)
    rows = docs.select(F.col("doc_id").alias("d"), "text")
    marks = rows.mapInArrow(lambda it: tidy(_marks(it)), f"d {kind}, e1 long, e2 long, some boolean, bands array<long>").checkpoint()
    copies = marks.where("some and d is not null").groupBy("e1", "e2").agg(F.min("d").alias("n")).checkpoint()
    nodes = marks.where("some").join(copies.select(F.col("n"), F.col("e1").alias("x1"), F.col("e2").alias("x2")), (F.col("d") == F.col("n")) & (F.col("e1") == F.col("x1")) & (F.col("e2") == F.col("x2")))
    banded = nodes.select("n", F.posexplode("bands").alias("band", "bh")).checkpoint()
    buckets = banded.groupBy("band", "bh").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("n").alias("r"), "n")).alias("lead")).where("size > 1")
    buckets = buckets.select(F.col("band").alias("band2"), F.col("bh").alias("bh2"), "size", F.col("lead.n").alias("a")).checkpoint()
    members = banded.join(buckets, (F.col("band") == F.col("band2")) & (F.col("bh") == F.col("bh2"))).select("band", "bh", "size", "a", "n").checkpoint()
    pairs = members.where("n <> a").select(F.least("a", "n").alias("a"), F.greatest("a", "n").alias("b")).distinct().checkpoint()
    wanted = pairs.select(F.col("a").alias("w")).union(pairs.select("b")).distinct()
    texts = rows.join(wanted, F.col("d") == F.col("w"), "left_semi").checkpoint()
    side = lambda k: texts.select(F.col("d").alias(f"d{k}"), F.col("text").alias(f"t{k}"))
    matched = pairs.join(side("b"), F.col("b") == F.col("db")).join(side("a"), F.col("a") == F.col("da")).select("a", "b", "ta", "tb")
    links = matched.mapInArrow(lambda it: tidy(_verify(it, threshold)), f"a {kind}, b {kind}").checkpoint()
    labels = components(links)
    # Buckets that still hold several components: their other pairs.
    comp = labels.select(F.col("n").alias("n2"), "c")
    sized = texts.select(F.col("d").alias("d2"), F.octet_length("text").alias("bytes")).groupBy("d2").agg(F.max("bytes").alias("bytes"))
    placed = members.where("size > 2").join(comp, F.col("n") == F.col("n2"), "left").join(sized, F.col("n") == F.col("d2")).select("band", "bh", "n", F.coalesce("c", "n").alias("c"), "bytes").distinct()
    placed = placed.checkpoint()
    each = placed.groupBy("band", "bh", "c").agg(F.count("*").alias("m"), F.sum("bytes").alias("bytes"))
    mixed = each.groupBy("band", "bh").agg(F.count("*").alias("parts"), F.sum("m").alias("m"), F.sum("bytes").alias("bytes"), F.max(F.struct("m", "c", "bytes")).alias("big")).where("parts > 1")
    # The nodes of the largest component make blocks of their own, which meet the other nodes' blocks only.
    in_blocks = lambda m, size: F.ceil(F.greatest(m / block, size / BLOCK_BYTES)).cast("int")
    whole = in_blocks(F.col("m"), F.col("bytes")) == 1
    rest = F.when(whole, 1).otherwise(in_blocks(F.col("m") - F.col("big.m"), F.col("bytes") - F.col("big.bytes")))
    mixed = mixed.select(F.col("band").alias("band2"), F.col("bh").alias("bh2"), F.col("big.c").alias("big"), rest.alias("few"), F.when(whole, 0).otherwise(in_blocks(F.col("big.m"), F.col("big.bytes"))).alias("many")).checkpoint()
    there = placed.join(mixed, (F.col("band") == F.col("band2")) & (F.col("bh") == F.col("bh2"))).select("n", "c", "band", "bh", "big", "few", "many").checkpoint()
    meets = there.groupBy(F.col("n").alias("n3")).agg(F.collect_list(F.struct("band", "bh")).alias("meets"))  # BANDS entries at most
    lot = F.xxhash64("n", "band")
    own = F.when((F.col("c") == F.col("big")) & (F.col("many") > 0), F.col("few") + F.pmod(lot, F.greatest("many", F.lit(1)))).otherwise(F.pmod(lot, F.col("few"))).cast("int")
    last = F.when(F.col("own") < F.col("few"), F.col("few") + F.col("many")).otherwise(F.col("few")) - 1
    units = there.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    units = units.select("n", "c", "band", "bh", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    told = texts.join(meets, F.col("d") == F.col("n3")).select("n3", "meets", "text")
    units = units.join(told, F.col("n") == F.col("n3")).select("n", "c", "band", "bh", "own", "i", "j", "meets", "text")
    more = units.groupBy("band", "bh", "i", "j").applyInArrow(_unit(threshold, arrow), f"a {kind}, b {kind}").checkpoint()
    if not more.isEmpty():  # they join components: labels of labels
        of = lambda k: comp.select(F.col("n2").alias(f"{k}n"), F.col("c").alias(f"{k}c"))
        joined = more.join(of("a"), F.col("a") == F.col("an"), "left").join(of("b"), F.col("b") == F.col("bn"), "left")
        over = components(joined.select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b")))
        own = labels.unionByName(more.select(F.col("a").alias("n")).union(more.select("b")).distinct().join(comp, F.col("n") == F.col("n2"), "left_anti").withColumn("c", F.col("n")))
        labels = own.join(over.select(F.col("n").alias("n4"), F.col("c").alias("c4")), F.col("c") == F.col("n4"), "left").select("n", F.coalesce("c4", "c").alias("c"))
    classes = copies.join(labels.select(F.col("n").alias("n2"), "c"), F.col("n") == F.col("n2"), "left").select(F.col("e1").alias("x1"), F.col("e2").alias("x2"), F.coalesce("c", "n").alias("class")).checkpoint()
    out = marks.join(classes, F.col("some") & (F.col("e1") == F.col("x1")) & (F.col("e2") == F.col("x2")), "left")
    class_id = F.when(F.col("d").isNotNull(), F.coalesce("class", "d"))
    return out.select(F.col("d").alias("doc_id"), class_id.alias("class_id"), (F.col("d").isNull() | (F.col("d") == class_id)).alias("kept"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, with one document of each class: its least doc_id; of equal rows of a doc_id and text, one.

    Where a doc_id comes with several texts, each is a document of its own, by a key of doc_id and text. Rows with a null
    doc_id stay.
    """
    named = docs.where("doc_id is not null")
    texts = F.struct(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi"))
    if named.groupBy("doc_id").agg(texts.alias("t")).where("t.lo <> t.hi").isEmpty():
        key = F.col("doc_id")
    else:
        kind = docs.schema["doc_id"].dataType.simpleString()
        place = F.concat("doc_id", F.lit("\0")) if kind == "string" else F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
        key = F.concat(place, F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))
    key_, kept_, nth_ = unused(docs, "key", "kept", "nth")
    kept = near_classes(named.select(key.alias("doc_id"), "text"), threshold).where("kept").select(F.col("doc_id").alias(kept_)).distinct()
    keyed = named.withColumn(key_, key).join(kept, F.col(key_) == F.col(kept_), "left_semi")
    nth = F.row_number().over(Window.partitionBy(key_).orderBy(F.xxhash64("text")))
    return keyed.withColumn(nth_, nth).where(F.col(nth_) == 1).drop(nth_, key_).unionByName(docs.where("doc_id is null"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_classes(table(spark, sf_dir, "documents"))
