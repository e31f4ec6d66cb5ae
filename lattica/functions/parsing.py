"""Parsers of model text as Column expressions: answer blocks, tool calls, tags, verdicts, ground truth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.text import LINE, WS, collapse, strip

MAX_ENTITIES = 50
# The delimiters of answers, calls and thoughts.
FENCE, ANSWER = "```", "entities"
CALL, END_CALL = "<tool_call>", "</tool_call>"
FUNCTION, END_FUNCTION = "<function=", "</function>"
PARAMETER, END_PARAMETER = "<parameter=", "</parameter>"
THINK, END_THINK = "<think>", "</think>"
TRUTH = "struct<answer_qids: array<string>, bridge_qids: array<string>>"


def between(text: Column, opening: str, closing: str) -> Column:
    """The bodies between an opening and the next closing delimiter, from left to right; what isn't closed is left out."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s)\\Q{opening}\\E(.*?)\\Q{closing}\\E"), F.lit(1))


def _answer_lines(text: Column, flags: str, gap: str = "[\\t ]*") -> Column:
    """Lines of the last fenced answer block: the fence with its name alone on the line, up to the next fence."""
    head = f"\\Q{FENCE}\\E{gap}{ANSWER}[\\t ]*(?:\\r\\n|\\n)"
    blocks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?{flags}){head}(.*?)\\Q{FENCE}\\E"), F.lit(1))
    return F.split(F.try_element_at(blocks, F.lit(-1)), LINE)


def parse_entities(text: Column, most: int = MAX_ENTITIES) -> Column:
    """Qids of the last fenced ``entities`` block: the first of each line, comments cut, distinct in order, at most ``most``."""
    lines = _answer_lines(text, "is")
    bare = F.transform(lines, lambda x: strip(F.regexp_replace(x, "(?s)(#|//).*$", "")))
    found = F.filter(F.transform(bare, lambda x: F.regexp_extract(x, r"(?U)\b[Qq](\d+)\b", 1)), lambda x: x != "")
    return F.coalesce(F.slice(F.array_distinct(F.transform(found, lambda x: F.concat(F.lit("Q"), x))), 1, most), F.array().cast("array<string>"))


def parse_entities_strict(text: Column) -> Column:
    """As a stricter parser has it: a lower-case fence, lines that are a qid and nothing else, no cap."""
    lines = _answer_lines(text, "s", "")
    found = F.filter(F.transform(lines, lambda x: strip(F.split_part(x, F.lit("#"), F.lit(1)))), lambda x: x.rlike("^Q[0-9]+$"))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def parse_tag(text: Column, tag: str) -> Column:
    """The collapsed body of the first <tag>; null where there is none or it is blank."""
    return F.nullif(collapse(F.regexp_extract(F.coalesce(text, F.lit("")), f"(?is)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))


def parse_reject(text: Column, reason: str = "unspecified") -> Column:
    """The reason of a <reject>; a default where it is blank, null where there is no tag."""
    return F.when(F.coalesce(text, F.lit("")).rlike("(?is)<reject>.*?</reject>"), F.coalesce(parse_tag(text, "reject"), F.lit(reason)))


def parse_judge(text: Column) -> Column:
    """pids (trimmed, upper case), unique and reason of the JSON between the first { and the last }; null without any."""
    got = F.from_json(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0), F.lit("")), "pids array<string>, unique boolean, reason string")
    pids = F.transform(F.coalesce(got["pids"], F.array().cast("array<string>")), lambda p: F.upper(F.trim(p)))
    return F.when(got.isNotNull(), F.struct(pids.alias("pids"), F.coalesce(got["unique"], F.lit(False)).alias("unique"), F.coalesce(got["reason"], F.lit("")).alias("reason")))


def judge_accepts(judged: Column, relations: Column) -> Column:
    """Unique, and the same relations as often, in any case of letters."""
    wanted = F.transform(relations, lambda p: F.upper(F.trim(p)))
    return F.coalesce(judged["unique"] & (F.array_sort(judged["pids"]) == F.array_sort(wanted)), F.lit(False))


def parse_tool_calls(text: Column) -> Column:
    """<tool_call>{json}</tool_call> calls with a name; bad JSON is skipped, arguments given as text are read again."""
    bodies = F.filter(F.transform(between(text, CALL, END_CALL), strip), lambda x: x.startswith("{") & x.endswith("}"))
    # Arguments come as their JSON text, whether they were an object or a text that holds one; each is parsed once.
    outer = F.transform(bodies, lambda x: F.from_json(x, "struct<name: string, arguments: string>"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    calls = F.transform(F.filter(outer, lambda c: c["name"].isNotNull()), lambda c: F.struct(c["name"].alias("name"), F.coalesce(F.from_json(c["arguments"], "map<string,string>"), none).alias("arguments")))
    return calls


def _named(body: Column) -> Column:
    """(key, value) of a body 'key>value'; the key is null where it is empty or has white space."""
    key = F.substring_index(body, ">", 1)
    value = strip(F.substring(body, F.length(key) + 2, F.length(body)))
    return F.struct(F.when((F.instr(body, ">") > 1) & ~key.rlike("(?U)\\s"), key).alias("key"), value.alias("value"))


def last_of_each(entries: Column) -> Column:
    """Entries (key, value) without those whose key comes again later."""
    later = lambda i: F.slice(entries, i + 2, F.size(entries))
    return F.filter(entries, lambda x, i: ~F.exists(later(i), lambda y: y["key"] == x["key"]))


def coerce_int(value: Column) -> Column:
    """The whole number that a text is (an optional minus and digits), else null."""
    return F.when(value.rlike("^-?[0-9]+$"), value.try_cast("long"))


def parse_function_calls(text: Column) -> Column:
    """<function=name><parameter=key>value</parameter></function> calls; values are trimmed text, of a repeated key the last."""
    calls = F.filter(F.transform(between(text, FUNCTION, END_FUNCTION), _named), lambda c: c["key"].isNotNull())

    def call(c: Column) -> Column:
        given = F.filter(F.transform(between(c["value"], PARAMETER, END_PARAMETER), _named), lambda p: p["key"].isNotNull())
        return F.struct(c["key"].alias("name"), F.map_from_entries(last_of_each(given)).alias("arguments"))

    return F.transform(calls, call)


def with_numbers(calls: Column) -> Column:
    """Calls with ``numbers`` beside their arguments: those that are whole numbers, as such."""
    numbers = lambda c: F.map_filter(F.transform_values(c["arguments"], lambda _, v: coerce_int(v)), lambda _, v: v.isNotNull())
    return F.transform(calls, lambda c: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments"), numbers(c).alias("numbers")))


def strip_markup(text: Column) -> Column:
    """Text without tool calls, function calls and thoughts."""
    spans = "|".join(f"\\Q{a}\\E.*?\\Q{b}\\E" for a, b in ((CALL, END_CALL), (THINK, END_THINK), (FUNCTION, END_FUNCTION)))
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), f"(?s){spans}", ""))


def ground_truth(text: Column) -> Column:
    """answer_qids and bridge_qids from a JSON object, or answers from a bare JSON list; bad JSON gives empty sets."""
    none = F.array().cast("array<string>")
    both, bare = F.from_json(text, TRUTH), F.from_json(text, "array<string>")
    listed = F.trim(text).startswith("[")
    return F.struct(
        F.coalesce(F.when(listed, bare).otherwise(both["answer_qids"]), none).alias("answer_qids"),
        F.coalesce(F.when(~listed, both["bridge_qids"]), none).alias("bridge_qids"),
    )


def words_in(text: Column) -> Column:
    """Words by white space; a stand-in for a tokenizer's length."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"(?U)[{WS}]+"), lambda x: x != ""))
