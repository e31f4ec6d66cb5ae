"""Graph pattern templates and their compilation to joins.

A template is a list of edges over variables. The compiler joins edges that share variables into components and
components into one plan, so a pattern with two long arms becomes a bushy join; inequality guards are applied as soon as
both variables are bound. The batch form computes the golden sets of every anchor at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.plans.triples import RELATIONS
from lattica.session import ensure_checkpoint_dir

MAX_ANSWERS = 30


@dataclass(frozen=True)
class Template:
    name: str
    kind: str
    edges: tuple[tuple[str, str, str], ...]
    anchors: tuple[str, ...]
    answer: str
    bridges: tuple[str, ...]
    guards: tuple[tuple[str, str, str], ...] = ()
    #: Guards that only narrow which anchors are sampled.
    sampler_guards: tuple[tuple[str, str, str], ...] = ()

    @property
    def hops(self) -> int:
        return len(self.edges)

    @property
    def relations(self) -> list[str]:
        return [r for _, r, _ in self.edges]


def _t(name: str, pattern: str, anchors: str, answer: str, bridges: str = "", guards: str = "", sampler_guards: str = "") -> Template:
    """A template from words such as 'film P57 d, d P69 school'."""
    cut = lambda s: tuple(tuple(x.split()) for x in s.split(",") if x.strip())
    return Template(name, name.split("_")[0], cut(pattern), tuple(anchors.split()), answer, tuple(bridges.split()), cut(guards), cut(sampler_guards))


TEMPLATES = {
    t.name: t
    for t in (
        _t("chain_film_director_school", "film P57 d, d P69 school", "school", "film", "d"),
        _t("chain_work_author_org", "w P50 a, a P463 org", "org", "w", "a"),
        _t("chain_person_company_founder", "p P108 c, c P112 founder", "founder", "p", "c"),
        _t("star_school_occupation", "p P106 occ, p P69 school", "school occ", "p"),
        _t("star_costars", "fa P161 x, fb P161 x", "fa fb", "x", "", "fa < fb"),
        _t("star_director_cast", "film P57 director, film P161 actor", "director actor", "film", "", "", "director <> actor"),
        _t("intersection_founder_school_owner", "x P69 school, y P112 x, y P127 owner", "school owner", "y", "x"),
        _t("chain_employee_founder_school", "p P108 c, c P112 f, f P69 school", "school", "p", "c f"),
        _t("intersection_org_member_school_country", "p P463 org, p P69 s, s P17 country", "org country", "p", "s"),
        _t("chain_same_school_directors", "film P57 d2, d2 P69 s, f1 P57 d1, d1 P69 s", "film", "f1", "d1 d2 s", "d1 <> d2, f1 <> film"),
        _t("chain_employee_subsidiary_founder_school", "p P108 c, c P127 parent, parent P112 f, f P69 school", "school", "p", "c parent f"),
    )
}


def _guard(df: DataFrame, guards: tuple, done: set) -> DataFrame:
    for g in guards:
        a, op, b = g
        if g not in done and a in df.columns and b in df.columns:
            df = df.where(F.col(a) < F.col(b) if op == "<" else F.col(a) != F.col(b))
            done.add(g)
    return df


def bindings(template: Template, edges: Callable[[str], DataFrame], sampler: bool = False) -> DataFrame:
    """All bindings of the template's variables; ``edges`` gives (src, dst) of a relation."""
    return _bind(template.name, template.edges, template.guards + (template.sampler_guards if sampler else ()), edges)


def _bind(name: str, pattern: tuple, guards: tuple, edges: Callable[[str], DataFrame]) -> DataFrame:
    done: set = set()
    parts: list[DataFrame] = []
    for a, rel, b in pattern:
        part = _guard(edges(rel).distinct().select(F.col("src").alias(a), F.col("dst").alias(b)), guards, done)
        rest = []
        for other in parts:
            shared = [x for x in other.columns if x in part.columns]
            if shared:
                part = _guard(other.join(part, shared), guards, done)
            else:
                rest.append(other)
        parts = [*rest, part]
    if len(parts) != 1:
        raise ValueError(f"{name} isn't connected")
    return parts[0]


@dataclass(frozen=True)
class Hub:
    """A variable into which two arms lead: all bindings of one meet all of the other there, a square of the hub's size.

    ``near`` holds the one anchor, ``far`` is answer - ``by`` - hub. The guards between the arms are answer <> anchor and by <> ``of``.
    """

    at: str
    near: tuple[tuple[str, str, str], ...]
    far: tuple[tuple[str, str, str], ...]
    by: str
    of: str


def hub(template: Template) -> Hub | None:
    """The hub of a template, if it has that form."""
    inner = {v for a, _, b in template.edges for v in (a, b)} - {template.answer, *template.anchors}
    for at in sorted(inner):
        far, seen = [], {template.answer}
        while more := [e for e in template.edges if e not in far and ({e[0], e[2]} - {at}) & seen]:
            far += more
            seen |= {v for e in more for v in (e[0], e[2])} - {at}
        near = [e for e in template.edges if e not in far]
        into = [[e for e in arm if e[2] == at] for arm in (near, far)]
        mids = seen - {template.answer}
        if len(template.anchors) != 1 or len(far) != 2 or len(mids) != 1 or not all(into) or seen & set(template.anchors):
            continue
        by, others = mids.pop(), {v for a, _, b in near for v in (a, b)}
        pairs = {frozenset((a, b)) for a, op, b in template.guards if op == "<>"}
        of = [v for v in others - {at} if frozenset((by, v)) in pairs]
        if len(of) == 1 and pairs == {frozenset((by, of[0])), frozenset((template.answer, template.anchors[0]))} and len(template.guards) == 2:
            return Hub(at, tuple(near), tuple(far), by, of[0])
    return None


def _arms(template: Template, h: Hub, edges: Callable[[str], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Both arms, the hubs' answers (hub, n), and how many of them only one ``by`` gives (hub, by, own)."""
    near, far = (_bind(template.name, arm, (), edges) for arm in (h.near, h.far))
    answers = far.groupBy(h.at, template.answer).agg(F.min(h.by).alias("lo_"), F.max(h.by).alias("hi_"))
    sizes = answers.groupBy(h.at).agg(F.count("*").alias("n_"))
    own = answers.where("lo_ = hi_").groupBy(h.at, F.col("lo_").alias(h.by)).agg(F.count("*").alias("own_"))
    return near, far, sizes, own


def _few_bindings(template: Template, h: Hub, edges: Callable[[str], DataFrame], most: int) -> DataFrame:
    """Bindings without those of anchors that have more than ``most`` answers for certain, by counts of the hubs alone.

    An answer is missed at a hub only if it is the anchor or all its ``by`` are ``of``, so n - own - 1 are left at least. Where
    more than twice as many meet as may stay, one ``of`` has to own the rest, and no anchor that stays sees its rows.
    """
    near, far, sizes, own = _arms(template, h, edges)
    counted = near.join(sizes, h.at).join(own.withColumnRenamed(h.by, h.of), [h.at, h.of], "left").withColumn("left_", F.col("n_") - F.coalesce("own_", F.lit(0)) - 1)
    many = counted.where(F.col("left_") > most).select(*template.anchors).distinct()
    near = near.join(many, list(template.anchors), "left_anti")
    owned = far.join(sizes, h.at).join(own, [h.at, h.by], "left").where((F.col("n_") <= 2 * (most + 1)) | (F.col("n_") - F.coalesce("own_", F.lit(0)) - 1 > most))
    return _guard(near.join(owned.drop("n_", "own_"), h.at), template.guards, set())


#: Answers and others that meet at one part of a hub, about; a hub's anchors are dealt out to as many parts as that takes.
UNIT = 4_000_000


def _without(array: Column, few: Column) -> Column:
    """An array without some values, in its order; one pass without a hash set where they are few."""
    return F.when(F.size(few) <= 8, F.filter(array, lambda q: ~F.array_contains(few, q))).otherwise(F.array_except(array, few))


def _hub_rows(template: Template, h: Hub, edges: Callable[[str], DataFrame], once: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Anchors with sets of any size in parts (see ``golden_parts``), without a row a binding; those that reach hubs in several ways; the hubs.

    A hub's answers and ``by`` are gathered once; each anchor has them and lists of what its guards exclude, which are short: what
    its ``of`` alone gives, and whose only answer it is. Only anchors that reach hubs in several ways are grouped once more.
    ``once``: the hubs are checkpointed, one row each, for those who read them again.
    """
    near, far, sizes, own = _arms(template, h, edges)
    anchor, answer, by = template.anchors[0], template.answer, h.by
    single = far.groupBy(h.at, answer).agg(F.min(by).alias("lo_"), F.max(by).alias("hi_")).where("lo_ = hi_").groupBy(h.at, F.col("lo_").alias(h.of)).agg(F.collect_set(answer).alias("own_"))
    lone = far.groupBy(h.at, by).agg(F.min(answer).alias("lo_"), F.max(answer).alias("hi_")).where("lo_ = hi_").groupBy(h.at, F.col("lo_").alias(anchor)).agg(F.collect_set(by).alias("lone_"))
    held = far.groupBy(h.at).agg(F.sort_array(F.collect_set(answer)).alias("all_"), F.sort_array(F.collect_set(by)).alias("by_"))
    parts = near.groupBy(h.at).agg(F.count("*").alias("m_")).join(sizes, h.at).select(h.at, F.ceil(F.col("m_") * F.col("n_") / UNIT).alias("parts_"))
    n = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [h.at, "part_"]
    held = held.join(parts, h.at).select(h.at, "all_", "by_", F.arrays_overlap("all_", "by_").alias("mixed_"), "parts_")
    if once:
        ensure_checkpoint_dir(held.sparkSession)
        held = held.checkpoint()
    held = held.select(h.at, "all_", "by_", "mixed_", F.explode(F.sequence(F.lit(1).cast("long"), "parts_")).alias("part_")).repartition(n, *keys)
    ways = near.groupBy(anchor).agg(F.count("*").alias("ways_"))
    near = near.join(ways, anchor).join(parts, h.at).join(single, [h.at, h.of], "left").join(lone, [h.at, anchor], "left")
    none = F.array().cast("array<string>")
    inner = [v for v in template.bridges if v != by]
    near = near.select(
        anchor, h.at, "ways_", (F.pmod(F.xxhash64(anchor, h.of), "parts_") + 1).alias("part_"),
        F.concat(F.coalesce("own_", none), F.array(anchor)).alias("out_"), F.array_distinct(F.array(*inner, anchor)).alias("near_"), F.concat(F.coalesce("lone_", none), F.array(h.of)).alias("not_"),
    )

    def met(rows: DataFrame) -> DataFrame:
        # An anchor without any answer goes before arrays are made.
        return rows.repartition(n, *keys).join(held, keys).where(F.exists("all_", lambda q: ~F.array_contains("out_", q)))

    answers = _without(F.col("all_"), F.col("out_"))
    others = F.when(F.col("mixed_"), F.array_except("by_", answers)).otherwise(F.col("by_"))
    kept = F.filter("near_", lambda q: ~F.array_contains("all_", q) | F.array_contains("out_", q))
    one = met(near.where("ways_ = 1")).select(anchor, *keys, F.col("all_").alias("answers"), F.col("out_").alias("less_answers"), others.alias("bridges"), F.concat("not_", "near_").alias("less_bridges"), kept.alias("more_bridges"))
    some = met(near.where("ways_ > 1")).select(anchor, "near_", answers.alias("answers"), _without(F.col("by_"), F.concat("not_", "near_")).alias("others_"))
    some = some.groupBy(anchor).agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("answers", "others_", "near_")))
    some = some.select(anchor, F.sort_array("answers").alias("answers"), none.alias("less_answers"), F.sort_array(F.array_except(F.concat("others_", "near_"), F.col("answers"))).alias("bridges"), none.alias("less_bridges"), none.alias("more_bridges"))
    return one, some, held


def _hub_parts(template: Template, h: Hub, edges: Callable[[str], DataFrame]) -> DataFrame:
    """Anchors with sets of any size in parts."""
    one, some, _ = _hub_rows(template, h, edges)
    return one.select(*some.columns).union(some)


def _hub_sets(template: Template, h: Hub, edges: Callable[[str], DataFrame]) -> DataFrame:
    """Anchors with the sorted arrays ``answers`` and ``bridges`` of sets of any size."""
    bridges = F.sort_array(F.concat(_without(F.col("bridges"), F.col("less_bridges")), F.col("more_bridges")))
    return _hub_parts(template, h, edges).select(*template.anchors, _without(F.col("answers"), F.col("less_answers")).alias("answers"), bridges.alias("bridges"))


def golden_parts(template: Template, edges: Callable[[str], DataFrame], max_answers: int | None = MAX_ANSWERS) -> DataFrame:
    """The golden sets as id, ``answers`` without ``less_answers``, ``bridges`` without ``less_bridges``, and ``more_bridges``.

    Arrays hold no id twice, those that are lacked may name others too; large arrays are a hub's own, not made for an anchor.
    """
    h = hub(template)
    if h is None or max_answers is not None:
        none = F.array().cast("array<string>")
        return golden(template, edges, max_answers).select("id", "answers", none.alias("less_answers"), "bridges", none.alias("less_bridges"), none.alias("more_bridges"))
    return _hub_parts(template, h, edges).select(_golden_id(template).alias("id"), "answers", "less_answers", "bridges", "less_bridges", "more_bridges")


def golden_hubs(template: Template, edges: Callable[[str], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """The parts of sets of any size where they are hubs' own (with hub_, part_ and anchor_), of other anchors, and the hubs (hub_, part_, all_, by_).

    The first and the last are dealt out by (hub_, part_). None where the template has no hub.
    """
    h = hub(template)
    if h is None:
        return None
    one, some, held = _hub_rows(template, h, edges, once=True)
    parts = ["answers", "less_answers", "bridges", "less_bridges", "more_bridges"]
    at = [F.col(h.at).alias("hub_"), "part_"]
    own = one.select(*at, F.col(template.anchors[0]).alias("anchor_"), _golden_id(template).alias("id"), *parts)
    return own, some.select(_golden_id(template).alias("id"), *parts), held.select(*at, "all_", "by_")


def record_id(prefix: str, parts: list[Column]) -> Column:
    """prefix-, then 12 hex digits of SHA-1 over the parts joined by '|'."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 12))


def _golden_id(template: Template) -> Column:
    return record_id("kg", [F.lit(template.name), F.array_join(F.array_sort(F.array(*template.anchors)), "|")])


def filter_answers(answers: Column, anchors: list[Column]) -> Column:
    """Answers without anchors and repeats."""
    return F.array_except(answers, F.array(*anchors))


def build_bridges(bridges: Column, anchors: list[Column], answers: Column) -> Column:
    """Intermediates and anchors that aren't answers, in order, once each."""
    return F.array_except(F.array_distinct(F.concat(bridges, F.array(*anchors))), answers)


def golden(template: Template, edges: Callable[[str], DataFrame], max_answers: int | None = MAX_ANSWERS) -> DataFrame:
    """One row an anchor tuple: id, anchors, answers, bridges (sorted arrays), n_answers, difficulty.

    Anchors are taken out of the answers before they are counted; sets of 1 to max_answers stay (None: any size).
    """
    h = hub(template)
    anchors = [F.col(a) for a in template.anchors]
    if h is not None and max_answers is None:
        got = _hub_sets(template, h, edges)
    else:
        rows = bindings(template, edges) if h is None else _few_bindings(template, h, edges, max_answers)
        if max_answers is not None:
            # Answers are counted before any set is gathered, so an anchor of very many answers never is one array.
            answer = F.col(template.answer)
            other = reduce(lambda x, y: x & y, [answer != a for a in anchors])
            few = rows.where(other).select(*template.anchors, answer.alias("answer_")).distinct().groupBy(*template.anchors).agg(F.count("*").alias("n_")).where(F.col("n_") <= max_answers)
            rows = rows.join(few.drop("n_"), list(template.anchors), "left_semi")
        sets = [F.collect_set(template.answer).alias("answers"), *(F.collect_set(b).alias(f"set_{b}") for b in template.bridges)]
        got = rows.groupBy(*template.anchors).agg(*sets).withColumn("answers", F.array_sort(filter_answers(F.col("answers"), anchors)))
        n = F.size("answers")
        got = got.where((n >= 1) & (n <= max_answers) if max_answers is not None else n >= 1)
        between = F.concat(*(F.col(f"set_{b}") for b in template.bridges)) if template.bridges else F.array().cast("array<string>")
        got = got.withColumn("bridges", F.array_sort(build_bridges(between, anchors, F.col("answers"))))
    return got.select(
        _golden_id(template).alias("id"),
        F.array_join(F.array(*anchors), "|").alias("anchors"),
        "answers",
        "bridges",
        F.size("answers").cast("long").alias("n_answers"),
        F.lit(template.hops).cast("long").alias("difficulty"),
    )


def anchor_pool(template: Template, edges: Callable[[str], DataFrame], seed_qid: str | None = None) -> DataFrame:
    """Distinct anchor tuples that have a binding, as one column each."""
    rows = bindings(template, edges, sampler=True)
    if seed_qid is not None:
        rows = rows.where(F.col(template.anchors[0]) == seed_qid)
    return rows.select(*template.anchors).distinct()


def describe(template: Template) -> str:
    """The template as text, with relation labels."""
    return ", ".join(f"{a} -{r} ({RELATIONS[r]})-> {b}" for a, r, b in template.edges)


def golden_sql(template: Template, triple_cte: str, max_answers: int = MAX_ANSWERS) -> str:
    """The same golden sets as SQL over one copy of the triples an edge."""
    at: dict[str, str] = {}
    where = []
    for i, (a, rel, b) in enumerate(template.edges):
        where.append(f"t{i}.rel = '{rel}'")
        for var, col in ((a, f"t{i}.src"), (b, f"t{i}.dst")):
            if var in at:
                where.append(f"{at[var]} = {col}")
            else:
                at[var] = col
    where += [f"{at[a]} {op} {at[b]}" for a, op, b in template.guards]
    anchors = ", ".join(template.anchors)
    bridges = " UNION ALL ".join([f"SELECT {anchors}, {v} AS q FROM m" for v in (*template.bridges, *template.anchors)])
    same = " AND ".join(f"{{0}}.{v} = {{1}}.{v}" for v in template.anchors)
    listed = "array_to_string([" + ", ".join(f"a.{v}" for v in template.anchors) + "], '|')"
    ordered = "array_to_string(list_sort([" + ", ".join(f"a.{v}" for v in template.anchors) + "]), '|')"
    return f"""
WITH {triple_cte}, m AS (
  SELECT DISTINCT {", ".join(f"{c} AS {v}" for v, c in at.items())} FROM {", ".join(f"triple t{i}" for i in range(len(template.edges)))} WHERE {" AND ".join(where)}
), ans AS (
  SELECT DISTINCT {anchors}, {template.answer} AS q FROM m WHERE {template.answer} NOT IN ({anchors})
), a AS (
  SELECT {anchors}, count(*) AS n_answers, string_agg(q, ',' ORDER BY q) AS answers FROM ans GROUP BY {anchors} HAVING count(*) <= {max_answers}
), br AS (
  SELECT DISTINCT * FROM ({bridges}) x WHERE NOT EXISTS (SELECT 1 FROM ans WHERE {same.format("ans", "x")} AND ans.q = x.q)
), b AS (
  SELECT {anchors}, string_agg(q, ',' ORDER BY q) AS bridges FROM br GROUP BY {anchors}
)
SELECT 'kg-' || left(sha1('{template.name}|' || {ordered}), 12) AS id, {listed} AS anchors, a.answers, coalesce(b.bridges, '') AS bridges, a.n_answers, CAST({template.hops} AS BIGINT) AS difficulty
FROM a LEFT JOIN b ON {same.format("a", "b")}
"""
