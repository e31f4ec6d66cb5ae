"""Question records of three sources, and the pieces that they are made of: anchors, rendered queries, description lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.ids import clean_qids
from lattica.functions.text import collapse
from lattica.operators import resolve
from lattica.plans.templates import Template, record_id

#: Code points of an abstract in a description line.
LINE_CHARS = 200


def first_of(columns: list[str], *keys: str) -> Column:
    """The first non-null of those keys that a table has; null if it has none."""
    there = [F.col(f"`{k}`") for k in keys if k in columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def anchors_of(slots: tuple[str, ...]) -> Column:
    """Sampler columns qid_<slot> and title_<slot> as one struct a slot; a null or empty qid raises, an empty title is the qid."""

    def one(slot: str) -> Column:
        qid, title = F.col(f"qid_{slot}"), F.col(f"title_{slot}")
        missing = qid.isNull() | (qid == "")
        return F.struct(
            F.when(missing, F.raise_error(F.lit(f"no anchor {slot}"))).otherwise(qid).alias("qid"), F.when(title.isNull() | (title == ""), qid).otherwise(title).alias("title")
        ).alias(slot)

    return F.struct(*map(one, slots))


def render(query: Column, values: dict[str, Column]) -> Column:
    """Each $name of a query becomes its value in quotes; longer names first, so that none is taken for the start of another."""
    for name in sorted(values, key=lambda n: (-len(n), n)):
        query = F.replace(query, F.lit(f"${name}"), F.concat(F.lit("'"), values[name], F.lit("'")))
    return F.regexp_replace(query, r"(?U)^\s+|\s+$", "")


def query_of(template: Template) -> str:
    """The template as text, with its anchors as $parameters."""
    node = lambda v: f"(${v})" if v in template.anchors else f"({v})"
    return f"{', '.join(f'{node(a)}-[{r}]->{node(b)}' for a, r, b in template.edges)} => {template.answer}"


def anchor_line(title: Column, role: Column, abstract: Column) -> Column:
    """What an anchor is, must be, and how its text begins, in one line."""
    told = F.substring(collapse(F.coalesce(abstract, F.lit(""))), 1, LINE_CHARS)
    return F.concat(F.lit('"'), title, F.lit('" — must be '), role, F.lit(' — abstract: "'), F.when(told == "", "(no abstract available)").otherwise(told), F.lit('"'))


def _record(record: Column, question: Column, answers: Column, bridges: Column, source: str, cypher: Column | None, difficulty: Column) -> list[Column]:
    none = F.lit(None).cast("string")
    return [record.alias("id"), question.alias("question"), clean_qids(answers).alias("answer_qids"), clean_qids(bridges).alias("bridge_qids"), F.lit(source).alias("source"), (none if cypher is None else cypher).alias("cypher"), difficulty.cast("int").alias("difficulty")]


def pattern_records(sets: DataFrame, template: Template, question: Column) -> DataFrame:
    """Records of golden sets (id, anchors joined by '|', answers, bridges): the rendered query, and hops as difficulty."""
    at = F.split("anchors", "[|]")
    values = {a: F.get(at, F.lit(i)) for i, a in enumerate(template.anchors)}
    return sets.select(*_record(F.col("id"), question, F.col("answers"), F.col("bridges"), "kg_pattern", render(F.lit(query_of(template)), values), F.lit(template.hops)))


def link_records(links: DataFrame, question: Column) -> DataFrame:
    """Records of text links (anchor, target, answers): bridges are the anchor, then the hop's target; two hops."""
    record = record_id("sim", [F.col("anchor"), F.array_join(F.array_sort("answers"), "|")])
    return links.select(*_record(record, question, F.col("answers"), F.array("anchor", "target"), "sim_link", None, F.lit(2)))


def benchmark_records(rows: DataFrame, aliases: DataFrame, entities: DataFrame, prefix: str = "frames") -> DataFrame:
    """Records of benchmark rows (idx, question, titles): all mapped ids are answers, and links are counted as difficulty, 1 at least.

    Rows without a question or without a mapped id give none.
    """
    question = F.trim(F.coalesce("question", F.lit("")))
    asked = rows.select(F.col("idx").alias("id"), question.alias("question"), F.coalesce("titles", F.array().cast("array<string>")).alias("titles")).where("question <> ''")
    mapped = resolve.map_titles(asked.select("id", "titles"), aliases, entities).where(F.size("qids") > 0)
    found = asked.join(mapped, "id")
    none = F.array().cast("array<string>")
    return found.select(*_record(F.concat(F.lit(f"{prefix}-"), F.col("id").cast("string")), F.col("question"), F.col("qids"), none, "frames", None, F.greatest(F.lit(1), F.size("titles"))))
