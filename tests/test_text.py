"""Text functions on literal rows: every rule and its edge cases, and laws that hold for any text."""

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoreloom.functions import evidence as ev
from scoreloom.functions import fuzzy
from scoreloom.functions import text as tx


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def test_norm(spark):
    assert apply(spark, tx.norm, ["A&B, Inc.", None, "  x\t y ", "Café Ltd"]) == ["a and b inc", "", "x y", "caf ltd"]
    assert apply(spark, tx.norm, ["Ｌtd ﬁne ½", None, "Ä①"]) == ["ltd fine 1 2", "", "1"]
    assert apply(spark, tx.norm_company, ["Foo Group USA Inc", "Holdings"]) == ["foo", ""]
    assert apply(spark, tx.canonical_key, ["Foo Group USA Inc", "Bar GmbH"]) == ["foo group usa", "bar"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x7F, exclude_categories=("Cs",)), max_size=40), min_size=1, max_size=20))
def test_norm_against_plain_python_and_twice(spark, values):
    def plain(x):
        x = unicodedata.normalize("NFKC", x).lower().replace("&", " and ")
        return " ".join(re.sub(r"[^a-z0-9 ]+", " ", x).split())

    once = apply(spark, tx.norm, values)
    assert once == [plain(v) for v in values] and apply(spark, tx.norm, once) == once


@pytest.mark.parametrize(("text", "count"), [
    ("Count: 1,200", 1200), ("Count: twenty two", 20), ("Count:\nNotes: x", None), ("Count: **5**", None), ("**Count:** 5", None), ("There are 1,200 rows", 1), ("tier 2 companies", None),
    ("none can be found", 0), ("There is only one site", 1), ("Acme has three locations", 3), ("the top five", 5), ("12 distinct suppliers", 12), ("", None), (None, None), ("Count: zero", 0),
    ("COUNT: 7", 7), ("There are 4 tier 3 companies", 4),
])
def test_counts(spark, text, count):
    assert apply(spark, tx.extract_count, [text]) == [count]


def test_count_on_the_same_line_only(spark):
    assert apply(spark, tx.extract_count, ["Count:\n9"]) == [9]
    assert apply(spark, lambda c: tx.extract_count(c, strict_line=True), ["Count:\n9", "Count: 9"]) == [None, 9]


def test_numbers_and_ids(spark):
    assert apply(spark, lambda c: tx.sorted_numbers(tx.extract_numbers(c)), ["1,200 and 7, 7 x9"]) == [["7", "1200"]]
    assert apply(spark, tx.supporting_ids, ["Supporting row_ids: 3, 3, 1234, 7", "Supporting row_ids:\nNotes: 5 ties", "none", None]) == [[3, 3, 7], [5], [], []]
    assert apply(spark, tx.natural_sorted, [["b10", "b2", "9", "10"]], "array<string>") == [["9", "10", "b2", "b10"]]


def test_values(spark):
    score = lambda value, numeric=False: lambda c: tx.value_match_score(F.lit(value), c, numeric)
    assert apply(spark, score("1200"), ["1,200"]) == [0.0] and apply(spark, score("5"), ["150"]) == [1.0]
    assert apply(spark, score("Battery Cell maker"), ["a battery maker of note"]) == [pytest.approx(2 / 3)]
    assert apply(spark, score("ab"), ["x"]) == [None] and apply(spark, score(" "), ["x"]) == [None]


def test_cleaning(spark):
    assert apply(spark, tx.clean_text, [" a ", " \n", None]) == ["a", None, None]
    assert apply(spark, tx.number_text, [250.0, 2.5, float("nan"), None], "double") == ["250", "2.5", None, None]
    assert apply(spark, tx.ns_to_seconds, ["2000000000", "12", "", "x", None]) == [2.0, 12.0, None, None, None]
    assert apply(spark, tx.normalize_bool, ["Yes", "0", "2", "y", "no", None]) == [True, False, True, True, False, False]
    assert apply(spark, lambda c: tx.half_even(c, 4), [0.12345, 0.12355], "double") == [0.1234, 0.1236]
    assert apply(spark, tx.county, ["Town, Hall, County", "Town", None]) == ["Hall, County", None, None]
    assert apply(spark, lambda c: tx.capped_cell(c, "!", 2, 5), ["123456", "12345"]) == ["123!", "12345"]
    assert apply(spark, lambda c: tx.safe_name(c, True), ["a:b/c d.e"]) == ["a_b_c_d_e"]


def test_model_output(spark):
    assert apply(spark, tx.strip_think, ["<THINK>a\nb</think> c", "<think>open"]) == ["c", "<think>open"]
    assert apply(spark, tx.json_body, ['```json\n{"a": 1}\n``` bye', "no braces"]) == ['{"a": 1}', "no braces"]
    assert apply(spark, tx.inline_thinking, ["let's think", "We need to go", "fine", None]) == [True, True, False, False]


def test_questions(spark):
    assert apply(spark, tx.question_type, ["Show all risk", "How many top firms?", "number of x", "Which county", "else"]) == [
        "list_multi_filter_judge_recommended", "aggregation_ranking", "count", "lookup", "list_or_lookup",
    ]
    assert apply(spark, tx.requested_fields, ["tier and role of suppliers", "suppliers where"]) == [["Category", "EV Supply Chain Role"], ["Location", "EV Supply Chain Role"]]


ANSWER = """Answer: see
Evidence:
| row_id | Company | Industry Group |
|---|:--:|---|
| 12 | **Foo Inc** | Bar Company |
| x | Baz; | q |
| 3 | | q |
Count: 2
Notes: none"""


def test_evidence(spark):
    rows = lambda text: [(r.row_id, r.company) for r in apply(spark, ev.evidence_rows, [text])[0]]
    assert rows(ANSWER) == [(12, "Foo Inc"), (None, "Baz")]
    assert rows("Evidence:\n| 12 | Foo |\n| 7 | Company Two |") == [(12, "Foo"), (7, "Company Two")]
    assert rows("Evidence:\n| Foo Company | 12 |\n| Bar | 3 |") == [(None, "Bar")]
    assert rows("Evidence: Count: 3") == [] and rows(None) == [] and rows("no sections | at | all") == []
    assert apply(spark, lambda c: ev.section(c, "Count"), [ANSWER, "x", None]) == [" 2\n", "", ""]


def test_ratio_is_not_symmetric(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, "a")], "a string, b string")
    assert [r.y for r in df.select(fuzzy.ratio("a", "b").alias("y")).collect()] == [0.25, 0.5, None]
    names = spark.createDataFrame([("abcd", ["xx", "abce", "abcf"]), ("q", ["z"]), ("q", [])], "a string, b array<string>")
    assert [(r.y.score, r.y["at"]) for r in names.select(fuzzy.best_of("a", "b").alias("y")).collect()] == [(0.75, 1), (0.0, None), (0.0, None)]
