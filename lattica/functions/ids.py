"""Identifiers: validation, numeric order, content hashes, stable splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks of difficulty words.
DIFFICULTY = {"trivial": 0.0, "easy": 1.0, "medium": 2.0, "hard": 3.0, "very_hard": 4.0}
UNKNOWN_DIFFICULTY = 2.0


def valid_qid(c: Column) -> Column:
    return c.rlike("^Q[0-9]+$")


def valid_pid(c: Column) -> Column:
    return c.rlike("^P[0-9]+$")


def number_of(qid: Column) -> Column:
    """The numeric part; what has none sorts last."""
    return F.coalesce(F.substring(qid, F.lit(2), F.length(qid)).try_cast("bigint"), F.lit(1 << 62))


def sort_numeric(qids: Column) -> Column:
    return F.transform(F.array_sort(F.transform(qids, lambda q: F.struct(number_of(q).alias("n"), q.alias("q")))), lambda x: x["q"])


def clean_qids(qids: Column) -> Column:
    """Distinct in order; raises where one isn't a qid."""
    good = F.forall(qids, valid_qid)
    return F.when(good, F.array_distinct(qids)).otherwise(F.raise_error(F.concat(F.lit("not a qid in "), F.array_join(qids, ","))))


def hash_fraction(c: Column) -> Column:
    """First 8 bytes of SHA-256 as a number in [0, 1)."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))


def split_of(c: Column, val_frac: float = 0.05) -> Column:
    return F.when(hash_fraction(c) < val_frac, "val").otherwise("train")


def seeded(seed: int, *parts: Column) -> Column:
    """An order that depends on the seed and the parts alone."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *parts), 256)


def difficulty_rank(c: Column, numeric: Column | None = None) -> Column:
    """A numeric difficulty as it is, a word by its rank, anything else in the middle; '3' as text is anything else."""
    known = F.create_map(*[F.lit(x) for kv in DIFFICULTY.items() for x in kv])
    return F.coalesce(*([numeric.cast("double")] if numeric is not None else []), F.try_element_at(known, F.lower(F.trim(c))), F.lit(UNKNOWN_DIFFICULTY))
