"""Operators and plans on literal rows: the semantics that the queries' SQL doesn't reach."""

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import text as tx
from scoreloom.operators import entities, gold, mentions, scoring
from scoreloom.plans import evaluation, inference, judge
from scoreloom.sources import answers as sources
from scoreloom.sources import knowledge
from scoreloom.streaming import scores as streaming

KB = [
    (1, "Acme Auto Parts Inc", "Tier 1", "Metal Stamping Works", "Alba, North County", "Battery casings", 250.0), (2, "Borealis Motors LLC", "OEM", "Vehicle Makers", "Bern, South County", "Cars and vans", None),
    (3, "Hollins & Vose Co", "Tier 2", "Filter Paper", "Cork, North County", "Filter media", 5.0), (4, "Acme Auto Parts Inc", "Tier 1", "Metal Stamping Works", "Dorn, East County", "Brackets", 10.0),
]


@pytest.fixture(scope="module")
def kb(spark):
    return spark.createDataFrame(KB, "row_id int, Company string, Category string, `Industry Group` string, Location string, `Product / Service` string, Employment double")


def test_set_scores(spark):
    df = spark.createDataFrame([([], []), (["a"], []), ([], ["a"]), (["a", "a", "b"], ["a", "c"])], "p array<string>, g array<string>")
    got = [tuple(r.s) for r in df.select(scoring.set_scores(F.col("p"), F.col("g")).alias("s")).collect()]
    assert got == [(1, 1, 1), (0, 1, 0), (0, 0, 0), (0.5, 0.5, 0.5)]


def test_entities_overlap_and_ties(spark):
    aliases = spark.createDataFrame([("A", "acme auto", 1), ("B", "acme", 2), ("C", "auto parts", 3), ("D", "acme auto", 4)], "company string, alias string, kb_ord int")
    texts = spark.createDataFrame([(1, "Acme Auto Parts"), (2, "parts of ACME; auto-parts"), (3, "acmeauto"), (4, None)], "k int, t string")
    got = {r.k: r.companies for r in entities.companies_in(texts, ["k"], "t", aliases).collect()}
    assert got == {1: ["A"], 2: ["A"], 3: [], 4: []}
    assert entities.companies_in(texts, ["k"], "t", aliases.limit(0)).filter("size(companies) = 0").count() == 4


def test_alias_table(kb):
    got = {(r.company, r.alias) for r in entities.alias_table(kb).collect()}
    assert ("Hollins & Vose Co", "hollins and vose co") in got and ("Hollins & Vose Co", "hollins and vose") in got and ("Acme Auto Parts Inc", "acme auto parts") in got


def test_mention_cascade(spark, kb):
    names = ["Acme Auto Parts Inc", "Metal Stamping Works", "Battery casings", "Borealis Motrs LLC", "Vose Co", "Zyx Quark Group", "various suppliers", "Supporting row_ids", "Company"]
    rows = "\n".join(f"| {i} | {n} | x |" for i, n in enumerate(names))
    a = spark.createDataFrame([(1, f"Evidence:\n| row_id | Company | c |\n{rows}"), (2, ""), (3, "Answer: Acme Auto Parts Inc and Plain words. Borealis Motors LLC")], "k int, response string")
    found = mentions.classify(mentions.mentions(a, ["k"]), ["k"], kb, entities.alias_table(kb))
    got = {r.mention_text: (r.classification, r.matched_kb_company) for r in found.filter("k = 1").collect()}
    assert got["Acme Auto Parts Inc"] == ("known_kb_company", "Acme Auto Parts Inc") and got["Metal Stamping Works"][0] == "industry_group_false_positive"
    assert got["Battery casings"][0] == "product_service_false_positive" and got["Borealis Motrs LLC"] == ("misspelled_kb_company", "Borealis Motors LLC")
    assert got["Vose Co"] == ("known_kb_company", "Hollins & Vose Co") and got["Zyx Quark Group"][0] == "true_out_of_kb_hallucination"
    assert got["various suppliers"][0] == got["Supporting row_ids"][0] == "not_a_company_phrase"
    counts = {r.k: r.n_known_kb_company for r in mentions.class_counts(found, a, ["k"]).collect()}
    assert counts == {1: 2, 2: 0, 3: 2}


def test_nearest_finds_what_all_pairs_find(spark):
    """Every best name above the threshold, ties by the table's order, against the plain ratio of all pairs."""
    rand = random.Random(1)
    names = ["".join(rand.choices("abcde ", k=rand.randint(4, 24))).strip() or "abcd" for _ in range(150)]
    names += [n[:3] + "x" + n[3:] for n in names[:30]]
    asked = []
    for n in names[:90]:
        k = rand.randrange(len(n))
        asked += [n[:k] + rand.choice("abz") + n[k:], n[:k] + n[k + 1 :], n[1:] + n[:1]]
    asked = sorted({a for a in asked if len(a) >= 5})
    df = spark.createDataFrame([(f"N{i}", i, n) for i, n in enumerate(names)], "Company string, kb_ord int, kb_key string")
    keys = spark.createDataFrame([(a,) for a in asked], "cand_key string")
    want, whole = {}, {}
    for a in asked:
        scores = [SequenceMatcher(None, a, n).ratio() for n in names]
        best = max(scores)
        whole[a] = (f"N{scores.index(best)}", best)
        if best >= tx.FUZZY_THRESHOLD:
            want[a] = whole[a]
    assert len(want) > 60
    assert {r.cand_key: (r.near, r.score) for r in mentions.nearest(keys, df).collect()} == want
    assert {r.cand_key: (r.near, r.score) for r in mentions.nearest_of_all(keys, df).collect()} == {a: v for a, v in whole.items() if v[1] > 0}


def test_parts_of_aliases(spark):
    rand = random.Random(2)
    aliases = ["".join(rand.choices("abc ", k=rand.randint(2, 12))) for _ in range(80)]
    short = ["".join(rand.choices("abc", k=rand.randint(4, 6))) for _ in range(200)]
    got = gold.part_of_any(spark.createDataFrame(list(enumerate(short)), "k int, s string"), "k", "s", spark.createDataFrame([(a,) for a in aliases], "alias string"), "alias")
    assert {r.k for r in got.collect()} == {k for k, s in enumerate(short) if any(s in a for a in aliases)}


def test_equal_answers_and_answers_without_a_model(spark, kb):
    said = "Answer: Acme Auto Parts Inc and Zyx Quark Group.\nEvidence:\n| row_id | Company |\n| 1 | Acme Auto Parts Inc |\n| 77 | Zyx Quark Group |\nCount: 2\nSupporting row_ids: 1, 77, 1\nNotes: 1956"
    rows = [("direct", "m", 1, said, "ok"), ("direct", "m", 1, said, "ok"), ("direct", None, 1, said, "ok"), (None, "m", 1, None, "error"), ("direct", "m", 9, said, "ok")]
    answers = spark.createDataFrame(rows, "arm string, model_name string, question_number int, response string, status string")
    g = spark.createDataFrame([(1, "Which suppliers are tier 1?", ["Acme Auto Parts Inc"], ["North County"], 1, ["1956", "77", "8"])], "question_number int, question string, gold_companies array<string>, gold_counties array<string>, gold_count int, gold_numbers array<string>")
    scores = evaluation.scored_answers(answers, g, kb)
    got = scores.collect()
    assert len(got) == 4 and len({r.answer_id for r in got}) == 4
    for r in (r for r in got if r.arm):
        assert (r.row_id_company_checked, r.row_id_bad_count, r.evidence_company_mentions, r.mention_known_kb_company_count, r.mention_true_hallucination_count) == (2, 1, 2, 1, 1)
        assert (r.numeric_recall, r.supporting_row_ids, r.bad_supporting_row_ids, r.duplicate_supporting_row_id_count, r.count_error) == (0.6667, "[1,77,1]", "[77]", 1, 1)
        assert r.company_f1 == 1.0 and r.county_f1 == 0.0 and json.loads(r.legacy_unknown_company_mentions) == ["Zyx Quark Group"] and r.has_notes_section and r.gold_county_count == 1
    failed = next(r for r in got if r.arm is None)
    assert not failed.answered and failed.entity_f1 == 0.0 and failed.mention_known_kb_company_count == 0 and failed.legacy_unknown_company_mention_count == 0
    summary = {(r.arm, r.model_name): r.questions for r in evaluation.model_summary(scores).collect()}
    assert summary == {("direct", "m"): 2, ("direct", None): 1, (None, "m"): 1}


def test_a_table_without_other_fields(spark):
    bare = spark.createDataFrame([(1, "Acme Auto Parts Inc")], "row_id int, Company string")
    a = spark.createDataFrame([(1, "Evidence:\n| row_id | Company |\n| 1 | Acme Auto Parts Inc |")], "k int, response string")
    assert mentions.classify(mentions.mentions(a, ["k"]), ["k"], bare, entities.alias_table(bare)).first().classification == "known_kb_company"


def test_row_ids(spark, kb):
    rows = "| 1 | Acme Auto Parts |\n| 2 | Acme Auto Parts Inc |\n| 3 | Hollins and Vos |\n| 9999 | X |\n| n | Y |"
    a = spark.createDataFrame([(1, f"Evidence:\n| id | Company |\n{rows}")], "k int, response string")
    got = [(r.cited_row_id, r.status, r.match_type) for r in mentions.row_id_checks(a, ["k"], kb, entities.alias_table(kb)).orderBy("ord").collect()]
    assert got[0] == (1, "match", "exact")
    assert got[1] == (2, "mismatch", None) and got[2][:2] == (3, "match") and got[2][2].startswith("fuzzy:") and got[3] == (9999, "bad_row_id", None) and len(got) == 4


def test_field_checks(spark, kb):
    a = spark.createDataFrame([(1, "They make brackets; 250 staff", ["Acme Auto Parts Inc", "Nobody"], ["Product / Service", "Employment", "Category"])], "k int, response string, gold_companies array<string>, requested_fields array<string>")
    got = {r.field: (r.field_value_score, r.field_value_present, r.expected_values) for r in scoring.field_checks(a, ["k"], kb, ["Category", "Product / Service", "Employment"]).collect()}
    assert got["Product / Service"][:2] == (1.0, True) and got["Product / Service"][2] == "Battery casings; Brackets" and got["Category"][0] == 0.0
    # a rounded score of 0.6 counts in the accuracy though it isn't "present"
    s = spark.createDataFrame([(1, 0.6), (1, None), (1, 0.1)], "k int, field_value_score double")
    assert scoring.field_accuracy(s, ["k"]).first().field_value_accuracy == pytest.approx(1 / 3)


# Published components and composites of seven models.
PUBLISHED = [
    (0.8131, 0.7778, 0.8272, 0.0, 1.0, 1.0, 0.8455, 1), (0.7659, 0.5, 0.7811, 0.0, 1.0, 1.0, 0.7618, 2), (0.5287, 0.2222, 0.7038, 0.0, 1.0, 1.0, 0.5879, 3), (0.5039, 0.2222, 0.7703, 0.0, 1.0, 1.0, 0.5867, 4),
    (0.442, 0.1944, 0.6252, 0.0238, 1.0, 1.0, 0.5292, 5), (0.3193, 0.1944, 0.5221, 0.0, 1.0, 1.0, 0.4609, 6), (0.2627, 0.1111, 0.677, 0.0714, 1.0, 1.0, 0.4349, 7),
]


def test_published_composites_and_ranks(spark):
    df = spark.createDataFrame(PUBLISHED, "f1 double, cnt double, fld double, hall double, fmt double, rel double, want double, want_rank int")
    c = F.col
    out = evaluation.ranked(df.withColumn("score", tx.half_even(scoring.composite(c("f1"), c("cnt"), c("fld"), c("hall"), c("fmt"), c("rel")), 4)), "score", "rank")
    for r in out.collect():
        assert abs(r.score - r.want) <= 1.01e-4 and r["rank"] == r.want_rank
    ties = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.4), ("d", None)], "n string, s double")
    assert {r.n: r["rank"] for r in evaluation.ranked(ties, "s", "rank").collect()} == {"a": 1, "b": 1, "c": 3, "d": 4}


def test_best_answer_of_a_question(spark):
    rows = [("x", "m1", 1, 0.5, True, 3), ("x", "m2", 1, 0.5, None, 3), ("x", "m3", 1, 0.5, False, 3), ("x", "m1", 2, None, True, 3), ("x", "m2", 2, None, False, 3)]
    df = spark.createDataFrame(rows, "arm string, model_name string, question_number int, entity_f1 double, count_correct boolean, gold_count int")
    got = {r.question_number: (r.best_model_by_entity_f1, r.mean_entity_f1, r.models_with_count_match, r.models_scored_for_count) for r in evaluation.question_summary(df).collect()}
    assert got == {1: ("x::m2", 0.5, 1, 2), 2: ("x::m1", None, 1, 2)}


def test_failing_clients(spark, kb):
    rows = knowledge.keyed_kb(kb).withColumn("line", F.to_json(F.struct("row_id", "Company")))
    q = spark.createDataFrame([("1", "a")], "q_id string, question string")

    def client(record):
        if record["stage"] == "map":
            return 'prose {"matched_row_ids": ["1", "1", "99", "2"]} more' if record["batch_id"] == "b001" else "no json"
        raise RuntimeError("down")

    out = inference.map_verify_reduce(q, rows, client, lambda df, _: df.cache(), size=2, retries=1).first()
    assert out.candidate_ids == ["1", "2"] == out.verified_ids and out.n_map_failed == 1 and out.dropped == 2
    assert (out.verify_status, out.reduce_status, out.reduce_answer) == ("failed", "failed", "")
    silent = inference.map_verify_reduce(q, rows, lambda r: '{"matched_row_ids": []}' if r["stage"] == "map" else "{}", lambda df, _: df.cache(), size=2).first()
    assert silent.candidate_ids == [] and silent.verify_status == "ok"


def test_retries_are_counted(spark):
    def client(record):
        raise ValueError("never")

    row = inference.called(spark.createDataFrame([(1,)], "k int"), client, retries=2).first()
    assert (row.attempts, row.call_status, row.output) == (3, "error", None) and row.error == "ValueError: never"


def test_run_status(spark):
    df = spark.createDataFrame([(28, 14, 42), (29, 13, 42), (0, 42, 42), (42, 0, 42), (1, 1, 2)], "done int, bad int, n int")
    got = [r.s for r in df.select(inference.run_status(F.col("done"), F.col("bad"), F.col("n")).alias("s")).collect()]
    assert got == ["runtime_unstable", "completed_with_errors", "failed", "completed", "runtime_unstable"]
    a = spark.createDataFrame([("a", "ok", 10, 1.0, 100, 10)], "model_name string, status string, prompt_eval_count int, runtime_seconds double, num_ctx int, approx_tokens int")
    out = {r.model_name: r.run_status for r in inference.run_summary(a, spark.createDataFrame([("a",), ("gone",)], "model_name string")).collect()}
    assert out == {"a": "completed", "gone": "failed"}


def test_leaked_gold_is_an_error(spark):
    q = spark.createDataFrame([(1, "what")], "question_number int, question string")
    gold = spark.createDataFrame([(1, "secret")], "question_number int, golden_answer string")
    assert inference.direct_prompts(q, "table", "rules", ["m"], gold).count() == 1
    with pytest.raises(Exception, match="gold answer in the prompt"):
        inference.direct_prompts(q, "a secret table", "rules", ["m"], gold).collect()


def test_judge(spark, kb):
    a = spark.createDataFrame([(1, [3, 9999], ["Acme Auto Parts Inc"]), (2, [77], []), (3, [], ["Borealis Motors LLC"])], "k int, cited array<int>, gold_companies array<string>")
    got = {r.k: (r.context_rows, r.context_basis, r.context_truncated, [json.loads(x)["row_id"] for x in r.context]) for r in judge.contexts(a, ["k"], kb, 2).collect()}
    assert got == {1: (2, "supporting+gold", True, [1, 3]), 2: (0, "none", False, []), 3: (1, "gold_companies", False, [2])}

    def rubric(metric, case):
        if metric == "usefulness" and case["k"] == 1:
            raise RuntimeError("no")
        return (1.0 if case["response"] == "(empty answer)" else 0.5), "r" * 900

    rows = {r.k: r for r in judge.judged(spark.createDataFrame([(1, ""), (2, "x")], "k int, response string"), rubric).collect()}
    assert rows[1].status == "partial_error" and rows[1].judge_mean == 1.0 and rows[2].judge_mean == 0.5 and len(rows[2].completeness_reason) == 600


def test_sources_and_sinks(spark, kb, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "answers_m.jsonl").write_text(json.dumps({"question_number": 1, "model": "m", "model_name": "", "model_response": "Count: 2", "status": "ok", "total_duration": 2_000_000_000}) + "\n\n")
    (tmp_path / "b.jsonl").write_text(json.dumps({"q_id": "2", "model": "n", "candidate_record_ids": ["1", "2"], "verified_record_ids": ["1"], "verification": {"verified_row_ids": []}, "timing": {"map_seconds": 1.5}}) + "\n")
    both = sources.both_arms(sources.direct_answers(spark, f"{tmp_path}/d/answers_*.jsonl"), sources.batch_answers(spark, f"{tmp_path}/b.jsonl"))
    got = {r.model_name: r for r in both.collect()}
    assert got["m"].runtime_seconds == 2.0 and got["n"].runtime_seconds == 1.5 and (got["n"].candidate_count, got["n"].verified_count) == (2, 1)
    assert both.columns == [c.split()[0] for c in sources.ANSWER_SCHEMA.split(", ")]
    with pytest.raises(ValueError):
        sources.both_arms(None, None)
    assert sources.narrowed(both, models=["m"]).count() == 1 and sources.narrowed(both, first=1).first().question_number == 1
    (tmp_path / "done.jsonl").write_text('{"arm": "direct_context", "model_name": "m", "question_number": 1}\nnot json\n{"arm": "x"}\n')
    assert [r.model_name for r in sources.still_to_do(both, sources.done_keys(spark, f"{tmp_path}/done.jsonl")).collect()] == ["n"]
    sources.write_tables({"answers": both, "kb": kb}, f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/kb").count() == 4
    sources.append_json(both.select("arm"), f"{tmp_path}/j")
    sources.append_json(both.select("arm"), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 4
    sources.write_config(spark, {"b": 1}, f"{tmp_path}/c")
    assert sources.fixed_columns(kb, ["row_id", "nowhere"]).columns == ["row_id", "nowhere"]


def test_knowledge_files(spark, tmp_path):
    (tmp_path / "kb.csv").write_text(" Company ,Location\nFoo , \n,\nBar,\"x, y\"\n")
    assert [(r.row_id, r.Company, r.Location) for r in knowledge.read_kb(spark, f"{tmp_path}/kb.csv").orderBy("row_id").collect()] == [(1, "Foo", None), (2, "Bar", "x, y")]
    (tmp_path / "q.txt").write_text("one\n\n two \n")
    assert [tuple(r) for r in knowledge.text_questions(spark, f"{tmp_path}/q.txt").collect()] == [(1, "one"), (2, "two")]
    assert [tuple(r) for r in knowledge.text_questions(spark, f"{tmp_path}/q.txt", by_line=True).collect()] == [(1, "one"), (3, "two")]
    (tmp_path / "q.jsonl").write_text('{"question": "a"}\n{"q_id": "z", "question": "b"}\n')
    assert [tuple(r) for r in knowledge.json_questions(spark, f"{tmp_path}/q.jsonl").collect()] == [("1", "a"), ("z", "b")]
    (tmp_path / "l.txt").write_text("# no\n\n m1\n")
    assert [r.value for r in knowledge.listed(spark, f"{tmp_path}/l.txt").collect()] == ["m1"]
    (tmp_path / "e.txt").write_text("# no\n")
    with pytest.raises(ValueError):
        knowledge.listed(spark, f"{tmp_path}/e.txt")
    gold = spark.createDataFrame([("1", "q", "yes"), ("x", "q", "no"), ("2.0", "q", None)], "` Num` string, Question string, `Human validated answers` string")
    assert sorted((r.question_number, r.golden_answer) for r in knowledge.gold_table(gold).collect()) == [(1, "yes"), (2, "")]


def test_stream_scores_each_answer_once(spark, tmp_path):
    schema = "arm string, model_name string, question_number int, response string, status string"
    rows = [("a", "m", i, f"Count: {i}", "ok") for i in range(3)]
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    for part in (rows, rows[:1] + [("a", "m", 9, "Count: 9", "ok")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        streaming.keep_scores(spark.readStream.schema(schema).parquet(source), target, f"{tmp_path}/state").awaitTermination()
    assert sorted((r.question_number, r.predicted_count) for r in spark.read.parquet(target).collect()) == [(0, 0), (1, 1), (2, 2), (9, 9)]
