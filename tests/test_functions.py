"""Exact numbers of scalar functions, parsers, metrics and rewards."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lattica.functions import ids, parsing, ranking
from lattica.functions import text as X


def one(spark, **columns):
    """The values of columns over one row."""
    row = spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()
    return row.asDict(recursive=True)


def arr(*xs):
    return F.array(*map(F.lit, xs)).cast("array<string>")


@pytest.mark.parametrize(
    "predicted,answer,bridge,want",
    [
        (["Q1", "Q2"], ["Q1"], ["Q2"], 1.0),
        (["Q2", "Q1"], ["Q1"], ["Q2"], (1 + 2 / 1.5849625) / (2 + 1 / 1.5849625)),
        (["Q1", "Q2", "Q9", "Q8"], ["Q1"], ["Q2"], 1.0),
        ([], ["Q1"], [], 0.0),
        (["Q1"], [], [], 0.0),
        (["Q1", "Q1", "Q2"], ["Q1"], ["Q2"], 1.0),
        (["Q9", "Q1"], ["Q1"], [], 0.6309298),
    ],
)
def test_ndcg(spark, predicted, answer, bridge, want):
    got = one(spark, x=ranking.ndcg_two_tier(arr(*predicted), arr(*answer), arr(*bridge)))["x"]
    assert got == pytest.approx(want, abs=1e-6)


def test_metric_edges(spark):
    many = [f"Q{i}" for i in range(60)]
    got = one(
        spark,
        cut=ranking.ndcg_two_tier(arr(*many[::-1]), arr("Q0"), arr()),
        none=ranking.ndcg_two_tier(arr("Q1"), arr("Q1"), arr(), 0),
        recall=ranking.recall_at_k(arr("Q1", "Q2", "Q3"), arr("Q1", "Q9")),
        recall_none=ranking.recall_at_k(arr("Q1"), arr()),
        f1=ranking.f1_set(arr(*many[:9]), arr("Q1")),
        f1_none=ranking.f1_set(arr(), arr("Q1")),
        both=ranking.ndcg_two_tier(arr("Q1"), arr("Q1"), arr("Q1")),
    )
    assert got == pytest.approx({"cut": 0.0, "none": 0.0, "recall": 0.5, "recall_none": 0.0, "f1": 0.2, "f1_none": 0.0, "both": 1.0})


def test_reward(spark):
    junk = [f"Q{i}" for i in range(100, 145)]
    cfg = ranking.RewardConfig(length_penalty=True)
    got = one(
        spark,
        perfect=ranking.reward(arr("Q1", "Q2"), arr("Q1"), arr("Q2")),
        dump=ranking.reward(arr("Q1", *junk), arr("Q1"), arr()),
        empty=ranking.reward(arr(), arr("Q1"), arr()),
        long=ranking.reward(arr("Q1"), arr("Q1"), arr(), F.lit(4072), cfg),
        clamp=ranking.reward(arr("Q9"), arr("Q1"), arr(), F.lit(40000), cfg),
        recall=ranking.reward(arr("Q1"), arr("Q1", "Q2"), arr(), config=ranking.RewardConfig(metric="recall")),
        over=ranking.reward(arr(*[f"Q{i}" for i in range(60)]), arr("Q1"), arr()),
    )
    assert got["perfect"]["total"] == pytest.approx(1.1)
    assert got["dump"]["dump_penalty"] == pytest.approx(0.18) and got["dump"]["junk_count"] == 45
    assert got["empty"]["total"] == 0 and not got["empty"]["parsed"] and got["empty"]["format_bonus"] == 0
    assert got["long"]["length_penalty"] == pytest.approx(0.1) and got["long"]["total"] == pytest.approx(1.0)
    assert got["clamp"]["total"] == 0
    assert got["recall"]["task_score"] == pytest.approx(0.5)
    assert got["over"]["truncated"] and got["over"]["n_entities"] == 50
    with pytest.raises(ValueError):
        ranking.RewardConfig(metric="other")


@pytest.mark.parametrize(
    "text,want",
    [
        ("```entities\nQ1\nQ2\n```", ["Q1", "Q2"]),
        ("```entities\nQ1\n```\nthen ```ENTITIES\r\nq3 # x\n- Q4, Q5\n// Q6\nQ3\n```", ["Q3", "Q4"]),
        ("```entities\nxQ7 Q08\n```", ["Q08"]),
        ("```entities\nQ1\n", []),
        ("no block", []),
        (None, []),
        ("```entities\n" + "\n".join(f"Q{i}" for i in range(60)) + "\n```", [f"Q{i}" for i in range(50)]),
        ("```entities\n```", []),
    ],
)
def test_answer_block(spark, text, want):
    assert one(spark, x=parsing.parse_entities(F.lit(text).cast("string")))["x"] == want


def test_strict_block_differs(spark):
    text = F.lit("```entities\nQ1 # c\nq2\nQ3 x\nQ4\n```")
    assert one(spark, x=parsing.parse_entities_strict(text))["x"] == ["Q1", "Q4"]


def test_tool_calls(spark):
    text = F.lit('a <tool_call>\n{"name": "f", "arguments": {"k": 1}}\n</tool_call><tool_call>{no}</tool_call><tool_call>{"name": "g", "arguments": "{\\"q\\": \\"x\\"}"}</tool_call><think>t\n</think> z')
    xml = F.lit("<function=f><parameter=k>\n3 </parameter></function>")
    got = one(spark, a=parsing.parse_tool_calls(text), b=parsing.parse_function_calls(xml), c=parsing.strip_markup(text))
    assert got["a"] == [{"name": "f", "arguments": {"k": "1"}}, {"name": "g", "arguments": {"q": "x"}}]
    assert got["b"] == [{"name": "f", "arguments": {"k": "3"}}] and got["c"] == "a  z"


def test_judge_and_truth(spark):
    j = parsing.parse_judge(F.lit('so {"pids": [" p69", "P57"], "unique": true} end'))
    got = one(
        spark,
        yes=parsing.judge_accepts(j, arr("P57", "P69")), twice=parsing.judge_accepts(j, arr("P57", "P69", "P69")), none=parsing.parse_judge(F.lit("nothing")),
        a=parsing.ground_truth(F.lit('{"answer_qids": ["Q1"], "bridge_qids": null}')), b=parsing.ground_truth(F.lit('["Q1", "Q2"]')), c=parsing.ground_truth(F.lit("{bad")),
        q=parsing.parse_tag(F.lit("<question> a\n b </question>"), "question"), e=parsing.parse_tag(F.lit("<question> </question>"), "question"), r=parsing.parse_reject(F.lit("x")),
    )
    assert got["yes"] and not got["twice"] and got["none"] is None
    assert got["a"] == {"answer_qids": ["Q1"], "bridge_qids": []} and got["b"]["answer_qids"] == ["Q1", "Q2"] and got["c"]["answer_qids"] == []
    assert got["q"] == "a b" and got["e"] is None and got["r"] is None


@pytest.mark.parametrize(
    "aliases,abstract,want",
    [
        (["Harvard", "Harvard University"], "Harvard University is old", "Harvard University"),
        (["HARVARD"], "harvardian ways", "HARVARD"),
        (["b", "a"], "nothing of it", "b"),
        (["x y", "X  Y"], ' "x y z', "x y"),
        (["first"], None, "first"),
        ([], "text", "Q5"),
    ],
)
def test_title_rule(spark, aliases, abstract, want):
    assert one(spark, x=X.title_rule(arr(*aliases), F.lit(abstract).cast("string"), F.lit("Q5")))["x"] == want


def test_snippets_and_texts(spark):
    long = "First one here. " + "x" * 300
    got = one(
        spark,
        s=X.snippet_sentence(F.lit(long)), hard=X.snippet_sentence(F.lit("y" * 250)), short=X.snippet_sentence(F.lit("abc")), flat=X.snippet_flat(F.lit(None).cast("string")),
        raw=X.snippet_raw(F.lit(None).cast("string")), doc=X.doc_text(F.lit("T"), F.lit(None).cast("string")), words=X.doc_text(F.lit("T"), F.lit("a b  c"), 2), cut=X.truncate(F.lit("abcdef"), 3, "!"),
    )
    assert got["s"] == "First one here." and got["hard"] == "y" * 200 + "…" and got["short"] == "abc" and got["flat"] == "(no description)"
    assert got["raw"] == "" and got["doc"] == "T. " and got["words"] == "T. a b" and got["cut"] == "abc!"


@pytest.mark.parametrize("url,want", [("https://e/wiki/A_b%20c#x", "A b c"), ("https://e/wiki/C%2B%2B?y", "C++"), ("https://e/wiki/a+b", "a+b"), ("https://e/w/none", None), ("https://e/wiki/%zz", "%zz")])
def test_url_title(spark, url, want):
    assert one(spark, x=X.title_from_url(F.lit(url)))["x"] == want


@pytest.mark.parametrize("title,text,want", [("Paris", "in PARIS, yes", True), ("Paris", "Parisian", False), ("cat", "a cat", False), ("C++ x", "some c++ x!", True), ("a.b*c", "has a.b*c in", True), ("Émile", "d'émile.", True), ("mile", "émile", False), ("ab\\Ecd", "x ab\\ecd y", True), ("long", None, False)])
def test_mentions(spark, title, text, want):
    assert one(spark, x=X.mentioned(F.lit(title), F.lit(text).cast("string")))["x"] == want


def test_ids(spark):
    h = int.from_bytes(hashlib.sha256(b"abc").digest()[:8], "big") / 2**64
    got = one(
        spark,
        f=ids.hash_fraction(F.lit("abc")), v=ids.valid_qid(F.lit("Q12")), bad=ids.valid_qid(F.lit("q12")), order=ids.sort_numeric(arr("Q10", "Q9", "Qx")), clean=ids.clean_qids(arr("Q2", "Q1", "Q2")),
        word=ids.difficulty_rank(F.lit(" Hard ")), text=ids.difficulty_rank(F.lit("3")), number=ids.difficulty_rank(F.lit(None).cast("string"), F.lit(7)), variants=X.title_variants(F.lit("new YORK")),
    )
    assert got["f"] == pytest.approx(h) and got["v"] and not got["bad"] and got["order"] == ["Q9", "Q10", "Qx"] and got["clean"] == ["Q2", "Q1"]
    assert got["word"] == 3 and got["text"] == 2 and got["number"] == 7 and got["variants"] == ["new YORK", "new york", "New york"]
    with pytest.raises(Exception, match="not a qid"):
        one(spark, x=ids.clean_qids(arr("Q1", "x")))
