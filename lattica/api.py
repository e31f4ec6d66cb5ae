"""The retrieval API: entities, neighbours, paths, vector search and guarded ad-hoc queries over one graph; tools over it by name."""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.text import QUERY_PREFIX, snippet_raw
from lattica.operators import graph, vectors

MAX_ROWS, TIMEOUT_S = 100, 2.0
#: What a query may be made of: clauses of a SELECT, and functions of its rows alone (none reads files, runs code or waits).
CLAUSES = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except Join SubqueryAlias UnresolvedRelation UnresolvedWith "
    "UnresolvedSubqueryColumnAliases UnresolvedInlineTable UnresolvedHaving OneRowRelation WithWindowDefinition Window CTERelationRef Generate LateralJoin ResolvedInlineTable LocalRelation".split()
)
FUNCTIONS = frozenset(
    "abs acos array array_contains array_distinct array_join array_max array_min array_position array_size array_sort avg bround cardinality cast ceil ceiling char_length coalesce collect_list "
    "collect_set concat concat_ws contains count count_if cos dense_rank element_at endswith exp explode filter first first_value flatten floor format_number greatest if ifnull initcap instr "
    "lag last last_value lead least left len length like ln locate log log10 log2 lower lpad ltrim max max_by mean median min min_by mod named_struct nullif nvl percent_rank pow power rank regexp_extract "
    "regexp_like regexp_replace repeat replace reverse right round row_number rpad rtrim sign sin size slice sort_array split sqrt startswith std stddev string struct substr substring sum transform "
    "translate trim try_divide try_element_at typeof upper variance int bigint double".split()
)


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def refusal(spark: SparkSession, query: str, relations: set[str]) -> str | None:
    """Why a query doesn't run: its parsed plan may have CLAUSES and FUNCTIONS only, over ``relations`` and names of its own WITH."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as e:  # noqa: BLE001
        return f"not a query: {str(e).splitlines()[0][:200]}"
    plans, own, asked = [plan], set(), []
    while plans:
        node = plans.pop()
        kind = node.getClass().getSimpleName()
        if kind not in CLAUSES:
            return f"{kind} isn't allowed"
        if kind == "UnresolvedRelation":
            asked.append(".".join(_items(node.multipartIdentifier())))
        if kind == "UnresolvedWith":
            for cte in _items(node.cteRelations()):
                own.add(cte._1().lower())
                plans.append(cte._2())
        plans += _items(node.children())
        expressions = _items(node.expressions())
        if kind == "UnresolvedInlineTable":
            expressions += [x for row in _items(node.rows()) for x in _items(row)]
        while expressions:
            e = expressions.pop()
            name = e.getClass().getSimpleName()
            if name == "UnresolvedFunction":
                called = ".".join(_items(e.nameParts())).lower()
                if called not in FUNCTIONS:
                    return f"the function {called} isn't allowed"
            elif name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
                plans.append(e.plan())
            elif name == "UnresolvedGenerator" and e.name().funcName().lower() not in FUNCTIONS:
                return f"the function {e.name().funcName()} isn't allowed"
            elif name in ("CallMethodViaReflection", "ScalaUDF", "PythonUDF", "UnresolvedTableValuedFunction"):
                return f"{name} isn't allowed"
            expressions += _items(e.children())
    other = [x for x in asked if x.lower() not in relations | own]
    return f"no relation {other[0]}" if other else None


class Retrieval:
    """Read-only retrieval over triples, entities, aliases, relation labels and vectors (id = qid, vec)."""

    def __init__(self, spark: SparkSession, triples: DataFrame, entities: DataFrame, aliases: DataFrame, labels: DataFrame, vecs: DataFrame | None = None, model=None):
        """``model`` is a function from texts to rows of numbers, for searches by text."""
        self.model = model
        self.spark, self.triples, self.entities, self.aliases, self.labels, self.vecs = spark, triples, entities, aliases, labels, vecs

    def get_entity(self, qid: str) -> DataFrame:
        """A card; LookupError if neither the entities nor the triples know the id."""
        graph.check_qid(qid)
        at = lambda df: df.where(F.col("qid") == qid)
        edges = self.triples.where((F.col("src") == qid) | (F.col("dst") == qid))
        rows = graph.cards(at(self.entities), at(self.aliases), edges).where(F.col("qid") == qid)
        if rows.isEmpty():
            raise LookupError(qid)
        return rows

    def get_neighbors(self, qid: str, relation: str | None = None, direction: str = "both", limit: int = 25, offset: int = 0) -> DataFrame:
        if relation is not None and not re.fullmatch(r"P[0-9]+", relation):
            raise ValueError(f"not a relation: {relation!r}")
        return graph.neighbors(self.triples, self.entities, self.labels, qid, relation, direction, limit, offset)

    def find_paths(self, src_qid: str, dst_qid: str, max_hops: int = 3, limit: int = 10) -> DataFrame:
        if graph.check_qid(src_qid) == graph.check_qid(dst_qid):
            raise ValueError("source and target are the same")
        pair = self.spark.createDataFrame([(src_qid, dst_qid)], "s string, t string")
        found = graph.shortest_paths(self.triples, pair, max_hops, limit)
        return graph.path_parts(found, self.entities, self.labels).select("length", "nodes", "edges", "path").orderBy("length", "path")

    def vector_search(self, query: str | list[float], k: int = 10) -> DataFrame:
        """qid, title, score (6 places) and snippet of the k entities nearest to a text, by the model, or to a vector."""
        graph.bounded("k", k)
        if isinstance(query, str):
            if self.model is None:
                raise ValueError("a search by text needs a model")
            graph.bounded("query", len(query))
            vec = self.model([QUERY_PREFIX + query])[0]
        else:
            vec = query
        query = self.spark.createDataFrame([("query", [float(x) for x in vec])], "id string, vec array<double>")
        hits = vectors.top_k(query, self.vecs, k).select(F.col("id").alias("qid"), "score", "rank")
        found = hits.join(self.entities, "qid", "left")
        return found.select("qid", F.coalesce("title", "qid").alias("title"), F.bround("score", 6).alias("score"), snippet_raw(F.col("abstract")).alias("snippet"), "rank").orderBy("rank")

    def run_sql(self, query: str, max_rows: int = MAX_ROWS, timeout_s: float = TIMEOUT_S) -> dict:
        """{rows, n} of a read-only query over triple, entity, alias and relation, or {rows: [], error}.

        The parsed plan decides (see ``refusal``), so a word within a text or a name refuses nothing, and files, other tables,
        and functions outside the list can't be reached. The four relations are names of a WITH around the query;
        views of the caller's session stay as they are. The cap is on the result, whatever limits the query has inside.
        """
        graph.bounded("query", len(query))
        text = query.strip().rstrip(";")
        views = {"triple": self.triples, "entity": self.entities, "alias": self.aliases, "relation": self.labels}
        why = refusal(self.spark, text, set(views))
        if why is not None:
            return {"rows": [], "error": why}
        sc, tag = self.spark.sparkContext, f"run_sql_{uuid.uuid4().hex}"
        for name, df in views.items():
            df.createOrReplaceTempView(f"{tag}_{name}")
        around = ", ".join(f"{name} AS (SELECT * FROM {tag}_{name})" for name in views)
        timer = threading.Timer(timeout_s, lambda: sc.cancelJobsWithTag(tag))
        sc.addJobTag(tag)
        timer.start()
        try:
            found = self.spark.sql(f"WITH {around} SELECT * FROM (\n{text}\n)").limit(max_rows).collect()  # at most max_rows
            rows = [{k: shaped(v) for k, v in r.asDict(recursive=True).items()} for r in found]
            return {"rows": rows, "n": len(rows)}
        except Exception as e:  # noqa: BLE001
            return {"rows": [], "error": str(e).splitlines()[0][:300]}
        finally:
            timer.cancel()
            sc.removeJobTag(tag)
            for name in views:
                self.spark.catalog.dropTempView(f"{tag}_{name}")


def shaped(value):
    """A value as JSON can hold it: dates and decimals as text, bytes as hex, within lists and maps too."""
    if isinstance(value, dict):
        return {str(k): shaped(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [shaped(v) for v in value]
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


#: Bodies of the tools: name -> (what it does, {argument: (type, required, bounds)}).
TOOLS = {
    "vector_search": ("The k entities nearest to a text or a vector.", {"query": ("string", True, None), "k": ("integer", False, graph.LIMITS["k"])}),
    "get_entity": ("One entity's card.", {"qid": ("string", True, None)}),
    "get_neighbors": ("A page of an entity's edges.", {"qid": ("string", True, None), "relation": ("string", False, None), "direction": ("string", False, None), "limit": ("integer", False, graph.LIMITS["limit"]), "offset": ("integer", False, None)}),
    "find_paths": ("Shortest paths between two entities.", {"src_qid": ("string", True, None), "dst_qid": ("string", True, None), "max_hops": ("integer", False, graph.LIMITS["max_hops"])}),
}


def tool_schemas(flavour: str = "function") -> list[dict]:
    """JSON schemas of the tools: 'function' (nested under function, parameters) or 'input' (flat, input_schema)."""

    def schema(arguments: dict) -> dict:
        each = {}
        for name, (kind, _, bounds) in arguments.items():
            each[name] = {"type": kind} | ({"minimum": bounds[0], "maximum": bounds[1]} if bounds else {}) | ({"default": bounds[2]} if bounds and bounds[2] is not None else {})
        return {"type": "object", "properties": each, "required": [n for n, (_, needed, _) in arguments.items() if needed]}

    if flavour == "function":
        return [{"type": "function", "function": {"name": n, "description": d, "parameters": schema(a)}} for n, (d, a) in TOOLS.items()]
    if flavour == "input":
        return [{"name": n, "description": d, "input_schema": schema(a)} for n, (d, a) in TOOLS.items()]
    raise ValueError(f"unknown flavour {flavour!r}")


class Client:
    """Calls tools by name on a Retrieval, or on anything else with its methods, and answers as dicts; errors are answers too."""

    def __init__(self, target):
        self.target = target

    def call(self, name: str, arguments: dict) -> dict:
        if name not in TOOLS:
            return {"error": f"unknown tool {name}"}
        missing = [n for n, (_, needed, _) in TOOLS[name][1].items() if needed and n not in arguments]
        if missing:
            return {"error": f"{name} needs {missing[0]}"}
        try:
            got = getattr(self.target, name)(**arguments)
        except (ValueError, LookupError, TypeError) as e:
            return {"error": str(e)}
        return got if isinstance(got, dict) else {"rows": [{k: shaped(v) for k, v in r.asDict(recursive=True).items()} for r in got.collect()]}  # pages are bounded


class Mock:
    """Stands in for a Retrieval: each tool's answers in turn, the last one again and again; keeps the calls."""

    def __init__(self, answers: dict[str, list[dict]]):
        self.answers, self.calls = {k: list(v) for k, v in answers.items()}, []

    def __getattr__(self, name: str):
        if name not in TOOLS:
            raise AttributeError(name)

        def answer(**arguments) -> dict:
            self.calls.append((name, arguments))
            left = self.answers.get(name) or [{"error": f"no answer for {name}"}]
            return left.pop(0) if len(left) > 1 else left[0]

        return answer


def intersect_neighbors(r: Retrieval, a: str, b: str) -> DataFrame:
    return graph.common_neighbors(r.triples, graph.check_qid(a), graph.check_qid(b))
