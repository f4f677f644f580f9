"""Gold answers' lines and unknown mentions on literal rows."""

from pyspark.sql import functions as F

from scoreloom.operators import entities, gold


def test_answer_parts(spark):
    lines = ["There are 3 firms", "top five", "OEM Footprint", "Foo counted once", "Role: x | Only company: Foo", "Area → only company: Bar [2]", "Baz | OEMs: Foo", "North County: Qux", "Plain [note]", ""]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, x string")
    got = [r.y for r in df.select("i", gold.answer_part(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == [None, None, None, None, "Foo", "Bar", "Baz", "Qux", "Plain", None]


def test_gold_companies_and_unknown_mentions(spark):
    aliases = spark.createDataFrame([("Foo Works Inc", "foo works", 1), ("Bar Steel LLC", "bar steel llc", 2)], "company string, alias string, kb_ord int")
    g = spark.createDataFrame([(1, "- Foo Works | OEMs: Bar Steel LLC"), (2, "There are Bar Steel LLC"), (3, None), (4, "")], "question_number int, t string")
    assert {r.question_number: r.gold_companies for r in gold.gold_companies(g, "question_number", "t", aliases).collect()} == {1: ["Foo Works Inc"], 2: ["Bar Steel LLC"], 3: [], 4: []}
    a = spark.createDataFrame([(1, "by Nova Prime Inc. and Foo Works Inc and Steel Bar Group; Bar Steel Co"), (2, None), (3, "Works Inc")], "k int, response string")
    got = sorted((r.k, r.mention) for r in gold.unknown_mentions(a, ["k"], aliases).collect())
    assert (1, "Nova Prime Inc") in got or (1, "Nova Prime Inc.") in got
    assert not any(m.startswith(("Foo Works", "Bar Steel", "Works")) for _, m in got)
    record = gold.gold_records(g.select("question_number", F.lit("how many suppliers").alias("question"), F.lit("There are 12 firms in 2020").alias("golden_answer")), aliases, aliases.select(F.lit("c").alias("county"), F.lit("zz").alias("alias")).limit(1)).first()
    assert (record.gold_count, record.gold_numbers, record.question_type) == (12, ["2020"], "count")
