"""Field values met by candidates' lengths only, and rubrics that show a metric no more than it is to see."""

import pytest

from scoreloom.operators.mentions import _field_hits
from scoreloom.plans import judge


def test_long_values_cost_in_proportion(spark):
    long = " ".join(f"w{i}" for i in range(600))
    kb = spark.createDataFrame([("Acme", long, "Battery Cells"), ("Bolt", "w7 w9", None)], "Company string, `Product / Service` string, Category string")
    asked = spark.createDataFrame([("w7 w8",), ("w7 w9",), ("w598 w599",), ("w7",), ("battery cells",), ("cells",)], "cand_norm string")
    hits = _field_hits(asked, kb)
    assert {(r.cand_norm, r.field, r.part) for r in hits.collect()} == {
        ("w7 w8", "Product / Service", 1), ("w598 w599", "Product / Service", 1), ("w7 w9", "Product / Service", 0), ("battery cells", "Category", 0)
    }
    assert _field_hits(asked, kb.select("Company")).count() == 0


def test_rubrics_show_only_what_they_name(spark):
    cases = spark.createDataFrame([("q", "a", "secret")], "question string, response string, gold string")
    seen = judge.judged(cases, lambda m, case: (len(case), ",".join(sorted(case))), {"blind": judge.Rubric(("one",), ("response",)), "all": judge.Rubric(("two",))}).first()
    assert seen.blind_reason == "response,steps" and seen.all_reason == "gold,question,response,steps" and seen.status == "ok"
    with pytest.raises(ValueError, match="nowhere"):
        judge.judged(cases, lambda m, case: (0, ""), {"x": judge.Rubric((), ("nowhere",))})
