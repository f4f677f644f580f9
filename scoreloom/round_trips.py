"""Queries over what the sources and sinks write and read back, and over steps around callables, each with its SQL."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import functions as F

from .functions import text as tx
from .operators import mentions as me
from .operators import ranks as rk
from .operators import scoring as sc
from .operators import sublists as sl
from .plans import evaluation, inference, judge
from .queries import ORACLES, query, t
from .sources import answer_log as lg
from .sources import answers as an
from .sources import knowledge as kn
from .sources import upserts as up
from .sources import varying as va
from .sources import workbook as wb
from .sources.stored import new_path
from .streaming import runs


@query("SELECT CAST(n AS INT) AS question_number, CAST(2 * n - 1 AS INT) AS line, question FROM (SELECT row_number() OVER (ORDER BY n_nationkey) AS n, 'Who is in ' || n_name AS question FROM nation)")
def questions_of_a_text_file(spark, sf_dir):
    """A line a question, blank lines between them; numbered by position and by line."""
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat(F.lit(" Who is in "), "n_name").alias("q"))))
    path = new_path(spark)
    t(spark, sf_dir, "nation").agg(F.array_join(F.transform(rows, lambda r: r["q"]), "\n\n").alias("value")).write.text(path)
    return kn.text_questions(spark, path).join(kn.text_questions(spark, path, by_line=True).withColumnRenamed("question_number", "line"), "question")


@query("SELECT CASE WHEN n_nationkey % 3 = 0 THEN CAST(row_number() OVER (ORDER BY n_nationkey) AS VARCHAR) ELSE 'q' || n_nationkey END AS q_id, 'Who is in ' || n_name AS question FROM nation")
def questions_of_json_lines(spark, sf_dir):
    """Those without an id are named by their position."""
    path, k = new_path(spark), F.col("n_nationkey")
    n = t(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    n.select(F.when(k % 3 != 0, F.concat(F.lit("q"), k.cast("string"))).alias("q_id"), F.concat(F.lit(" Who is in "), "n_name").alias("question")).write.json(path)
    return kn.json_questions(spark, path)


@query("SELECT p_name || p_partkey AS value FROM part WHERE p_partkey % 3 = 1")
def list_file(spark, sf_dir):
    """Comments and blank lines are left out."""
    path, k = new_path(spark), F.col("p_partkey")
    named = F.concat("p_name", k.cast("string"))
    t(spark, sf_dir, "part").select(F.when(k % 3 == 0, F.concat(F.lit("# "), named)).when(k % 3 == 1, F.concat(F.lit("  "), named, F.lit(" "))).otherwise(" ").alias("value")).write.text(path)
    return kn.listed(spark, path)


@query("SELECT CAST(p_partkey AS INT) AS question_number, p_name AS question, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END AS golden_answer, p_brand AS use_case_category FROM part WHERE p_partkey % 5 > 1")
def tolerant_gold(spark, sf_dir):
    """Columns found by what their names hold; rows whose number isn't whole are left out."""
    k = F.col("p_partkey")
    number = F.when(k % 5 == 0, "n/a").when(k % 5 == 1, F.concat(k.cast("string"), F.lit(".5"))).otherwise(F.concat(k.cast("string"), F.lit(".0")))
    return kn.gold_table(t(spark, sf_dir, "part").select("p_retailprice", F.col("p_name").alias(" Question"), F.when(k % 7 != 0, F.col("p_type")).alias("Validated text "), number.alias(" Num "), F.col("p_brand").alias("Use Case Category"), "p_size"))


@query("""SELECT 'direct_context' AS arm, CASE WHEN c_custkey % 3 = 0 THEN 'fallback' ELSE 'm' || c_nationkey END AS model_name, CAST(c_custkey AS INT) AS question_number, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS response,
  CASE WHEN c_custkey % 2 = 0 THEN (c_custkey + 2000000) / 1e9 ELSE CAST(c_custkey AS DOUBLE) END AS runtime_seconds, -1 AS map_failed_count, -1 AS candidate_count, -1 AS verified_count FROM customer
UNION ALL SELECT 'batchwise_map_reduce', 'b', CASE WHEN s_suppkey % 6 = 0 THEN -1 ELSE CAST(s_suppkey AS INT) END, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END, s_suppkey + 0.5 + CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1.25 END,
  CAST(s_suppkey % 9 AS INT), CAST(s_suppkey % 3 AS INT), CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END FROM supplier""")
def answers_of_both_arms(spark, sf_dir):
    """Appended JSON lines of both arms, read as one table."""
    direct, batch, k = new_path(spark), new_path(spark), F.col("c_custkey")
    c = t(spark, sf_dir, "customer").select(
        k.alias("question_number"), F.when(k % 3 == 1, F.concat(F.lit("m"), F.col("c_nationkey").cast("string"))).when(k % 3 == 2, F.concat(F.lit("m"), F.col("c_nationkey").cast("string"))).when(k % 2 == 0, "").alias("model_name"),
        F.lit("fallback").alias("model"), F.when(k % 4 != 0, F.col("c_name")).alias("model_response"), F.when(k % 2 == 0, k + 2000000).otherwise(k).alias("total_duration"),
    )
    an.append_json(c.filter("question_number % 2 = 0"), direct)
    an.append_json(c.filter("question_number % 2 = 1"), direct)
    s = F.col("s_suppkey")
    ids = lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>"))
    an.append_json(t(spark, sf_dir, "supplier").select(
        F.when(s % 6 == 0, "none").otherwise(s.cast("string")).alias("q_id"), F.lit("b").alias("model"), F.when(s % 4 != 0, F.col("s_name")).alias("reduce_answer"), ids(s % 3).alias("candidate_record_ids"),
        F.struct((s + 0.5).alias("map_seconds"), F.when(s % 5 != 0, F.lit(1.25)).alias("verify_seconds")).alias("timing"), F.struct((s % 9).alias("n_map_failed")).alias("diagnostics"),
        F.struct(F.when(s % 2 == 0, F.array(F.lit("1"))).otherwise(F.array().cast("array<string>")).alias("verified_row_ids")).alias("verification"), F.array(F.lit("1"), F.lit("2")).alias("verified_record_ids"),
    ), batch)
    both = an.both_arms(an.direct_answers(spark, direct), an.batch_answers(spark, batch))
    counts = ["map_failed_count", "candidate_count", "verified_count"]
    return both.select("arm", "model_name", "question_number", "response", "runtime_seconds", *counts).na.fill(-1, ["question_number", *counts])


@query("SELECT DISTINCT event_type AS arm, 'm' || CAST(user_id % 5 AS VARCHAR) AS model_name, CAST(user_id AS INT) AS question_number FROM events WHERE event_id % 4 > 1")
def keys_judged_before(spark, sf_dir):
    """Lines that are cut off or lack a key are left out."""
    path, e = new_path(spark), F.col("event_id")
    line = F.to_json(F.struct(F.col("event_type").alias("arm"), F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model_name"), F.when(e % 4 != 1, F.col("user_id")).alias("question_number")))
    t(spark, sf_dir, "events").select(F.when(e % 4 == 0, F.left(line, F.lit(20))).otherwise(line).alias("value")).write.text(path)
    return an.done_keys(spark, path)


@query("SELECT event_type AS arm, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def judge_records_read_again(spark, sf_dir):
    """S12."""
    path = new_path(spark)
    an.append_json(t(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), "value"), path)
    return an.judged(spark, path, "arm string, value double").groupBy("arm").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT 'customers' AS sheet, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(NULL AS VARCHAR) AS nowhere FROM customer UNION ALL SELECT 'nations', CAST(n_nationkey AS VARCHAR), '[\"' || n_name || '\",\"x\"]', CAST(NULL AS VARCHAR) FROM nation")
def tables_as_csv(spark, sf_dir):
    """A folder a sheet, columns in a fixed order, lists as JSON, null as blank."""
    path, names = new_path(spark), ["id", "name", "nowhere"]
    n = t(spark, sf_dir, "nation").select(F.array("n_name", F.lit("x")).alias("name"), F.col("n_nationkey").alias("id"), "n_regionkey")
    an.write_tables({"customers": an.fixed_columns(t(spark, sf_dir, "customer").withColumnsRenamed({"c_custkey": "id", "c_name": "name"}), names), "nations": an.fixed_columns(n, names)}, path)
    read = lambda sheet: spark.read.option("header", True).options(**kn.CSV).csv(f"{path}/{sheet}").select(F.lit(sheet).alias("sheet"), *names)
    return read("customers").unionByName(read("nations"))


@query("SELECT count(*) AS suppliers, 'm1' AS model, '/a/b' AS kb FROM supplier")
def config_document(spark, sf_dir):
    """K07."""
    path = new_path(spark)
    an.write_config(spark, {"suppliers": t(spark, sf_dir, "supplier").count(), "model": "m1", "kb": PurePosixPath("/a/b")}, path)
    return spark.read.option("multiLine", True).schema("suppliers bigint, model string, kb string").json(path)


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND user_id IN (1, 2, 3, 5, 8, 13)")
def narrowed_answers(spark, sf_dir):
    """questions named win over a limit."""
    e = t(spark, sf_dir, "events").withColumnsRenamed({"event_type": "model_name", "user_id": "question_number"})
    return an.narrowed(e, ["click", "view"], [1, 2, 3, 5, 8, 13], first=1).select("event_id")


def stub_judge(metric: str, case: dict) -> tuple[float, str]:
    """Scores by the key and the metric's place; fails on usefulness of every fourth case."""
    if metric == "usefulness" and case["s_suppkey"] % 4 == 0:
        raise ValueError("no score")
    return (case["s_suppkey"] % 5) / 10 + judge.METRICS.index(metric) / 100, f"{metric} of {case['response']}"


def stub_rubric_judge(metric: str, case: dict) -> tuple[float, str]:
    """Scores by how an empty answer is shown; the reason tells what it was shown."""
    score = (2 if case["response"] == "(empty answer)" else 3) + (2 if metric == "blind" else 0)
    return score / 10, "; ".join(case["steps"]) + ": " + ",".join(sorted(k for k in case if k != "steps"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'partial_error' ELSE 'ok' END AS status, (s_suppkey % 5) / 10 + 0.01 AS completeness, 'completeness of ' || CASE WHEN s_suppkey % 3 = 0 THEN '(empty answer)' ELSE s_name END AS reason, "
       "CASE WHEN s_suppkey % 4 = 0 THEN 'ValueError: no score' ELSE 'usefulness of ' || CASE WHEN s_suppkey % 3 = 0 THEN '(empty answer)' ELSE s_name END END AS last_reason, round((s_suppkey % 5) / 10 + CASE WHEN s_suppkey % 4 = 0 THEN 0.02 ELSE 0.025 END, 6) AS judge_mean FROM supplier")
def judged_answers(spark, sf_dir):
    """A metric that fails leaves the others."""
    cases = t(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("response"))
    made = judge.judged(cases, stub_judge)
    return made.select("s_suppkey", "status", "completeness", F.col("completeness_reason").alias("reason"), F.col("usefulness_reason").alias("last_reason"), F.round("judge_mean", 6).alias("judge_mean"))


_MADE_UP = "concat('Zyq', translate(cast(s_suppkey as {text}), '0123456789', 'bcdfghjklm'), ' Wortex Group')"


@query(f"SELECT s_suppkey, {_MADE_UP.format(text='VARCHAR')} AS mention_text FROM supplier WHERE s_suppkey % 2 = 0")
def prose_without_sections(spark, sf_dir):
    """Without an Answer section the first 800 characters are looked at, and no more."""
    name = F.expr(_MADE_UP.format(text="string"))
    said = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("there we met "), name, F.lit(" today"), F.repeat(F.lit(" and so on"), 100))).otherwise(F.concat(F.repeat(F.lit("and so on "), 100), name))
    return me.mentions(t(spark, sf_dir, "supplier").select("s_suppkey", said.alias("response")), ["s_suppkey"]).select("s_suppkey", "mention_text")


@query("""SELECT k, max(CAST(CASE WHEN k % 3 = 0 AND s_suppkey % 2 = 0 THEN 1.0 WHEN k % 3 = 1 AND s_suppkey % 2 = 1 THEN 0.333 ELSE 0.0 END AS DOUBLE)) AS field_value_score, bool_or(k % 3 = 0 AND s_suppkey % 2 = 0) AS field_value_present,
  string_agg(CASE WHEN s_suppkey % 2 = 0 THEN 'Gamma Wheel' ELSE 'Delta cover, spring' END, '; ' ORDER BY s_suppkey) AS expected_values FROM (SELECT s_suppkey, s_suppkey // 2 AS k FROM supplier) GROUP BY k""")
def best_field_values(spark, sf_dir):
    """The best score over the rows of a company, two a company."""
    k = F.floor(F.col("s_suppkey") / 2)
    s = t(spark, sf_dir, "supplier").select("s_suppkey", k.alias("k"), F.concat(F.lit("Firm "), k.cast("string")).alias("Company"))
    kb = s.select("Company", (F.col("s_suppkey") + 1).alias("row_id"), F.when(F.col("s_suppkey") % 2 == 0, "Gamma Wheel").otherwise("Delta cover, spring").alias("Product / Service"))
    said = F.when(F.col("k") % 3 == 0, "a gamma wheel!").when(F.col("k") % 3 == 1, "some DELTA").otherwise("nothing")
    a = s.select("k", "Company").distinct().select("k", F.array("Company").alias("gold_companies"), F.array(F.lit("Product / Service")).alias("requested_fields"), said.alias("response"))
    return sc.field_checks(a, ["k"], kb, ["Product / Service"]).select("k", "field_value_score", "field_value_present", "expected_values")


@query("""SELECT row_number() OVER (ORDER BY s_suppkey) AS row_id, 'Firm ' || s_suppkey || chr(10) || ' "and" sons, ltd' AS Company, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN '"' ELSE 'a,b' || chr(10) || chr(10) || 'c\\"' END AS Category FROM supplier""")
def csv_cells(spark, sf_dir):
    """Cells with line breaks, quotes, commas and backslashes, written and read as RFC 4180 has them."""
    k, path = F.col("s_suppkey"), new_path(spark)
    firm = F.concat(F.lit("Firm "), k.cast("string"), F.lit('\n "and" sons, ltd'))
    s = t(spark, sf_dir, "supplier").orderBy("s_suppkey").select(firm.alias(" Company "), F.when(k % 3 == 1, '"').when(k % 3 == 2, 'a,b\n\nc\\"').alias("Category"))
    an.write_tables({"kb": s.coalesce(1)}, path)
    return kn.read_kb(spark, f"{path}/kb")


@query("""WITH last AS (SELECT s_suppkey // 3 AS k, max(s_suppkey) AS g FROM supplier GROUP BY 1)
SELECT c_custkey, CAST(g AS INT) AS gold_count, CAST(c_custkey % 7 AS INT) AS pred_count FROM customer JOIN last ON k = c_custkey % 40""")
def repeated_gold_numbers(spark, sf_dir):
    """Of gold rows of one number the last counts, and each answer keeps one row."""
    s, none = F.col("s_suppkey"), F.array().cast("array<string>")
    gold = t(spark, sf_dir, "supplier").select(F.floor(s / 3).cast("int").alias("question_number"), F.lit("How many?").alias("question"), none.alias("gold_companies"), none.alias("gold_counties"), s.cast("int").alias("gold_count"), s.alias("gold_at"))
    c = F.col("c_custkey")
    answers = t(spark, sf_dir, "customer").select("c_custkey", (c % 40).cast("int").alias("question_number"), F.concat(F.lit("Count: "), (c % 7).cast("string")).alias("response"))
    scored = answers.join(evaluation.gold_of(gold.repartition(5)), "question_number")
    return scored.select("c_custkey", "gold_count", tx.extract_count(F.col("response")).alias("pred_count"))


@query("""SELECT c_custkey, CAST(least(3, c_custkey % 5) AS INT) AS context_rows, c_custkey % 5 > 3 AS context_truncated, CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE 'supporting+gold' END AS context_basis,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE (SELECT string_agg(CAST(r AS VARCHAR), ',' ORDER BY r) FROM (SELECT unnest(range(1, 1 + least(3, c_custkey % 5))) AS r)) END AS ids FROM customer""")
def contexts_of_like_keys(spark, sf_dir):
    """Keys that are null or repeat leave each answer its own rows."""
    c = F.col("c_custkey")
    kb = t(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1).cast("int").alias("row_id"), F.col("s_name").alias("Company")).filter("row_id < 10")
    cited = F.when(c % 5 > 0, F.sequence(F.lit(1), (c % 5).cast("int"))).otherwise(F.array().cast("array<int>"))
    answers = t(spark, sf_dir, "customer").select("c_custkey", F.when(c % 2 == 0, "m").alias("arm"), F.lit(None).cast("string").alias("model_name"), cited.alias("cited"), F.array().cast("array<string>").alias("gold_companies"))
    made = judge.contexts(answers, ["arm", "model_name", "c_custkey"], kb, max_rows=3)
    ids = F.array_join(F.transform("context", lambda x: F.get_json_object(x, "$.row_id")), ",")
    return made.select("c_custkey", "context_rows", "context_truncated", "context_basis", ids.alias("ids"))


@query("SELECT event_id FROM events WHERE event_id % 5 > 0 AND (event_id % 3 <> 0 OR user_id % 2 <> 0)")
def resume_by_null_keys(spark, sf_dir):
    """A key that was judged with a null in it isn't asked anew."""
    path, e = new_path(spark), F.col("event_id")
    keyed = t(spark, sf_dir, "events").select("event_id", "user_id", F.when(e % 5 > 0, F.concat("event_type", e.cast("string"))).alias("arm"), F.when(e % 3 == 1, "m").alias("model_name"), F.when(e % 3 == 2, e.cast("int")).alias("question_number"))
    an.append_json(keyed.filter("event_id % 5 = 0 OR (event_id % 3 = 0 AND user_id % 2 = 0)").select("arm", "model_name", "question_number"), path)
    return an.still_to_do(keyed, an.done_keys(spark, path)).select("event_id")


def echo_client(record: dict) -> str:
    """Says what it was given."""
    return f"{record['id']}|{type(record['id']).__name__}|{record['beside']}|{record['many']}"


@query("""SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 > 0 THEN 9007199254740993 + c_custkey END AS VARCHAR) AS id, coalesce(CAST(CASE WHEN c_custkey % 3 > 0 THEN 9007199254740993 + c_custkey END AS VARCHAR), 'None') || '|' || CASE WHEN c_custkey % 3 > 0 THEN 'int' ELSE 'NoneType' END || '|' || CASE WHEN c_custkey % 2 > 0 THEN CAST(c_nationkey AS VARCHAR) ELSE 'None' END || '|['
  || c_custkey || ', ' || CASE WHEN c_custkey % 4 > 0 THEN CAST(c_custkey + 9007199254740993 AS VARCHAR) ELSE 'None' END || ']' AS output FROM customer""")
def exact_values_of_calls(spark, sf_dir):
    """Whole numbers beyond 2^53, nulls beside them and lists reach a client and come back as they are."""
    c = F.col("c_custkey")
    big = c + F.lit(9007199254740993)
    rows = t(spark, sf_dir, "customer").select("c_custkey", F.when(c % 3 > 0, big).alias("id"), F.when(c % 2 > 0, F.col("c_nationkey")).alias("beside"), F.array(c, F.when(c % 4 > 0, big)).alias("many"))
    return inference.called(rows, echo_client).select("c_custkey", F.col("id").cast("string").alias("id"), "output")


@query("""SELECT 'customers' AS sheet, c_custkey AS id, CASE WHEN c_custkey % 4 > 0 THEN c_name || chr(10) || '"' || c_mktsegment || '", <&>' END AS said, c_acctbal AS amount, CAST(NULL AS VARCHAR) AS day FROM customer
UNION ALL SELECT 'parts / sizes', p_partkey, repeat('x', CAST(32767 - 3 * (p_partkey % 2) AS INT)), CAST(p_size AS DOUBLE) / 8, CAST(DATE '1995-06-17' + CAST(p_partkey AS INT) AS VARCHAR) FROM part WHERE p_partkey <= 40""")
def workbook_sheets(spark, sf_dir):
    """Two tables as sheets of one workbook, and both read back from it, line breaks, quotes, full cells, dates and nulls included."""
    path, c, p = f"{new_path(spark)}.xlsx", F.col("c_custkey"), F.col("p_partkey")
    said = F.when(c % 4 > 0, F.concat(F.col("c_name"), F.lit('\n"'), F.col("c_mktsegment"), F.lit('", <&>')))
    customers = t(spark, sf_dir, "customer").select(c.alias("id"), said.alias("said"), F.col("c_acctbal").cast("double").alias("amount"), F.lit(None).cast("date").alias("day"))
    parts = t(spark, sf_dir, "part").filter("p_partkey <= 40").select(p.alias("id"), F.repeat(F.lit("x"), (32767 - 3 * (p % 2)).cast("int")).alias("said"), (F.col("p_size") / 8).alias("amount"), F.date_add(F.lit("1995-06-17").cast("date"), p.cast("int")).alias("day"))
    wb.write_workbook({"customers": customers, "parts / sizes": parts}, path)
    read = lambda sheet, name: wb.read_workbook(spark, path, sheet, "id bigint, said string, amount double, day date").select(F.lit(name).alias("sheet"), "id", "said", "amount", F.col("day").cast("string").alias("day"))
    return read("customers", "customers").unionByName(read("parts _ sizes", "parts / sizes"))


@query("SELECT row_number() OVER (ORDER BY s_suppkey) AS row_id, s_name || chr(10) || 'ltd' AS Company, n_name AS Location, CAST(CAST(s_acctbal AS DECIMAL(15,2)) AS VARCHAR) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def knowledge_of_a_workbook(spark, sf_dir):
    """A knowledge table out of a spreadsheet, rows in the sheet's order, empty ones left out."""
    path = f"{new_path(spark)}.xlsx"
    s = t(spark, sf_dir, "supplier").join(t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = s.select("s_suppkey", F.concat(F.lit(" "), "s_name", F.lit("\nltd ")).alias(" Company "), F.col("n_name").alias("Location"), F.col("s_acctbal").cast("decimal(15,2)").cast("string").alias("balance"))
    blank = rows.select("s_suppkey", *[F.lit(None).cast("string").alias(x) for x in rows.columns[1:]])
    wb.write_workbook({"kb": rows.unionByName(blank).repartitionByRange(3, "s_suppkey").sortWithinPartitions("s_suppkey").drop("s_suppkey")}, path)
    return kn.read_kb(spark, path, "workbook")


def batch_client(record: dict) -> str:
    """Fails on every seventh."""
    if record["id"] % 7 == 0:
        raise ValueError("no answer")
    return f"{record['id']} {record['name']}"


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 7 > 0 THEN c_custkey || ' ' || CASE WHEN c_custkey % 3 > 0 THEN c_name ELSE 'None' END END AS output, CASE WHEN c_custkey % 7 > 0 THEN 'ok' ELSE 'error' END AS call_status, CASE WHEN c_custkey % 7 = 0 THEN 'ValueError: no answer' END AS error FROM customer")
def answers_logged_by_batches(spark, sf_dir):
    """Calls fed batch by batch into a log whose commits make each answer durable; run twice, each answer is there once."""
    folder, c = new_path(spark), F.col("c_custkey")
    prompts = t(spark, sf_dir, "customer").select(c.alias("id"), F.when(c % 3 > 0, F.col("c_name")).alias("name"))
    for _ in range(2):
        lg.feed(prompts, lambda stream: inference.called(stream, batch_client), folder, files=4, per_batch=2)
    return lg.logged_answers(spark, f"{folder}/log", "id long, name string, output string, call_status string, error string").select("id", "output", "call_status", "error")


@query(ORACLES["run_summary"].replace("SELECT model_name, n AS total", "SELECT coalesce(model_name, 'none') AS model_name, n AS total"))
def runs_as_they_end(spark, sf_dir):
    """Answers that arrive as a stream, each twice; a model's last row comes by a timer when it falls silent, and says what run_summary says of the finished log."""
    key, path = "spark.sql.streaming.stateStore.providerClass", new_path(spark)
    a = t(spark, sf_dir, "events").selectExpr(
        "event_type as model_name", "cast(event_id as int) as question_number", "if(event_id % (case event_type when 'error' then 1 when 'click' then 2 when 'view' then 50 else 1000000 end) = 0 and event_type <> 'signup', 'error', 'ok') as status",
        "if(event_type = 'signup', 2048, 1000 + event_id % 50) as prompt_eval_count", "value as runtime_seconds", "65536 as num_ctx", "1100 as approx_tokens", "cast(ts as timestamp) as ts",
    ).withColumns({"prompt_eval_count": F.col("prompt_eval_count").cast("int")})
    a.unionByName(a).write.parquet(f"{path}/in")
    # The clock of the stream moves on with one answer of another model, far behind all others.
    later = a.agg(F.max("ts").alias("ts")).selectExpr("'~' as model_name", "1 as question_number", "'ok' as status", "1 as prompt_eval_count", "1d as runtime_seconds", "1 as num_ctx", "1 as approx_tokens", "ts + interval 9 days as ts")
    later.write.mode("append").parquet(f"{path}/in")
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        states = runs.run_states(spark.readStream.schema(a.schema).parquet(f"{path}/in"), silent="1 day")
        kept = states.writeStream.outputMode("update").foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{path}/out"))
        kept.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    ended = spark.read.schema(runs.STATUS_SCHEMA).parquet(f"{path}/out").filter("ended").na.fill(-1, ["prompt_min", "prompt_median", "prompt_max"])
    return ended.select("model_name", "total_questions", "completed_answers", "error_count", "prompt_min", "prompt_median", "prompt_max", "context_status", "run_status")


@query("""SELECT o_orderkey, rank() OVER (ORDER BY o_orderdate DESC, o_orderpriority) AS rank, dense_rank() OVER (ORDER BY o_orderdate DESC, o_orderpriority) AS dense_rank,
  row_number() OVER (ORDER BY o_orderdate DESC, o_orderpriority, o_orderkey) AS row_number FROM orders""")
def ranks_of_all_orders(spark, sf_dir):
    """Ranks with ties over a whole table, no task of which sees all rows."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    made = rk.with_ranks(o, [(F.col("o_orderdate"), True), (F.col("o_orderpriority"), False)], [(F.col("o_orderkey"), False)])
    return made.select("o_orderkey", "rank", "dense_rank", "row_number")


@query("""SELECT o_orderkey, rank() OVER (ORDER BY o_orderstatus) AS rank, dense_rank() OVER (ORDER BY o_orderstatus) AS dense_rank, row_number() OVER (ORDER BY o_orderstatus, o_orderkey DESC) AS row_number FROM orders""")
def ranks_of_few_values(spark, sf_dir):
    """Three values in all, so that ties go on over many partitions."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return rk.with_ranks(o, [(F.col("o_orderstatus"), False)], [(F.col("o_orderkey"), True)]).drop("o_orderstatus")


_GRAINS = """WITH s AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS arm, CASE WHEN o_custkey % 6 > 0 THEN 'm' || o_custkey % 6 END AS model_name, CAST(o_orderkey % 40 AS INT) AS question_number, o_orderkey % 3 = 0 AS judge_recommended,
  o_orderkey % 7 > 0 AS answered, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 101) / 100 END AS entity_f1, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 9 > 2 END AS count_correct, CAST(o_orderkey % 11 AS DOUBLE) / 10 AS field_value_accuracy,
  o_orderkey % 2 = 0 AS format_core_ok, CAST(o_orderkey % 1000 AS INT) AS prompt_eval_count, CAST(o_orderkey % 13 AS DOUBLE) AS runtime_seconds FROM orders)"""


@query(f"""{_GRAINS} SELECT CASE grouping_id(arm, model_name, question_number, judge_recommended) WHEN 3 THEN 'model' WHEN 13 THEN 'question' WHEN 7 THEN 'arm' WHEN 14 THEN 'judged' ELSE 'all' END AS grain, arm, model_name, coalesce(question_number, -1) AS question_number, coalesce(CAST(judge_recommended AS VARCHAR), '-') AS judge_recommended,
  count(*) AS answers, count(*) FILTER (WHERE answered) AS answered, count(*) FILTER (WHERE answered) / count(*) AS reliability, round(avg(entity_f1), 9) AS mean_entity_f1, count(count_correct) AS count_questions_scored, round(avg(CAST(count_correct AS INT)), 9) AS count_accuracy_rate,
  round(avg(field_value_accuracy), 9) AS field_value_accuracy, avg(CAST(format_core_ok AS INT)) AS format_core_ok_rate, min(prompt_eval_count) AS prompt_eval_min, median(prompt_eval_count) AS prompt_eval_median, max(prompt_eval_count) AS prompt_eval_max, sum(runtime_seconds) AS total_runtime_seconds
  FROM s GROUP BY GROUPING SETS ((arm, model_name), (question_number), (arm), (judge_recommended), ())""")
def summary_of_all_grains(spark, sf_dir):
    """Model, question, arm and judge split in one pass, medians included; null arms and models are groups."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    scores = t(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("arm"), F.when(c % 6 > 0, F.concat(F.lit("m"), (c % 6).cast("string"))).alias("model_name"), (o % 40).cast("int").alias("question_number"),
        (o % 3 == 0).alias("judge_recommended"), (o % 7 > 0).alias("answered"), F.when(o % 5 > 0, (o % 101) / 100).alias("entity_f1"), F.when(o % 4 > 0, o % 9 > 2).alias("count_correct"), ((o % 11).cast("double") / 10).alias("field_value_accuracy"),
        (o % 2 == 0).alias("format_core_ok"), (o % 1000).cast("int").alias("prompt_eval_count"), (o % 13).cast("double").alias("runtime_seconds"),
    )
    made = evaluation.grain_summary(scores)
    made = made.withColumns({"question_number": F.coalesce("question_number", F.lit(-1)), "judge_recommended": F.coalesce(F.col("judge_recommended").cast("string"), F.lit("-"))})
    return made.withColumns({c: F.round(c, 9) for c in ("mean_entity_f1", "count_accuracy_rate", "field_value_accuracy")})


@query(r"""WITH d AS (SELECT DISTINCT trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS text FROM conversations WHERE text IS NOT NULL), b AS (SELECT DISTINCT trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS text FROM benchmark WHERE text IS NOT NULL),
y AS (SELECT array_to_string(string_split(text, ' ')[1:2], ' ') AS phrase FROM d UNION SELECT array_to_string(string_split(text, ' ')[1:3], ' ') FROM b UNION SELECT array_to_string(string_split(text, ' ')[3:3], ' ') FROM d),
p AS (SELECT text, string_split(text, ' ') AS t, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM d), g AS (SELECT text, i, array_to_string(t[i:i + k - 1], ' ') AS phrase FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(t))
SELECT phrase, count(DISTINCT text) AS texts, count(*) AS places FROM g SEMI JOIN y USING (phrase) WHERE phrase <> '' GROUP BY 1""")
def words_in_order(spark, sf_dir):
    """Which lists of words follow each other in which conversations, by sorted suffixes: how they and the benchmark's items begin, and their third words."""
    tidy = F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " "))
    d, b = (t(spark, sf_dir, name).filter("text IS NOT NULL").select(F.split(tidy, " ").alias("w"), tidy.alias("text")) for name in ("conversations", "benchmark"))
    begins = d.select(F.slice("w", 1, 2).alias("w")).unionByName(b.select(F.slice("w", 1, 3).alias("w"))).unionByName(d.select(F.slice("w", 3, 1).alias("w")))
    found = sl.sublists(begins.select(F.array_join("w", " ").alias("phrase")), d.select("text"))
    return found.groupBy("phrase").agg(F.count("*").alias("texts"), F.sum(F.size("starts")).alias("places"))


@query("""WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN 'm' || o_orderkey % 5 END AS model_name, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_custkey AS INT) END AS question_number FROM orders),
r AS (SELECT model_name, question_number, 1 AS round, k AS value FROM o UNION ALL SELECT model_name, question_number, 2, k + 1000000 FROM o WHERE k % 3 = 0 UNION ALL SELECT model_name, question_number, 0, k + 2000000 FROM o WHERE k % 2 = 0)
SELECT coalesce(model_name, '-') AS model_name, coalesce(question_number, -1) AS question_number, round, value FROM r QUALIFY row_number() OVER (PARTITION BY model_name, question_number ORDER BY round DESC, value DESC) = 1""")
def answers_upserted(spark, sf_dir):
    """Three rounds of answers put into a table by key, the last record of a key counts, null keys are keys."""
    path, k = new_path(spark), F.col("o_orderkey")
    o = t(spark, sf_dir, "orders").select(F.when(k % 5 > 0, F.concat(F.lit("m"), (k % 5).cast("string"))).alias("model_name"), F.when(k % 7 > 0, F.col("o_custkey").cast("int")).alias("question_number"), k.alias("value"))
    # Of one round's records of a key the greatest value is the last one.
    last = lambda df, at: df.groupBy("model_name", "question_number").agg(F.max("value").alias("value")).withColumn("at", F.lit(at))
    for rows in (last(o, 1), last(o.filter("value % 3 = 0").withColumn("value", F.col("value") + 1000000), 2), last(o.filter("value % 2 = 0").withColumn("value", F.col("value") + 2000000), 0)):
        up.upsert(rows, path, ["model_name", "question_number"], "at", buckets=16)
    return up.upserted(spark, path).select(F.coalesce("model_name", F.lit("-")).alias("model_name"), F.coalesce("question_number", F.lit(-1)).alias("question_number"), F.col("at").alias("round"), "value")


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'direct_context' ELSE 'batchwise_map_reduce' END AS arm, 'm' || o_orderkey % 3 AS model_name, CAST(o_custkey AS INT) AS question_number,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS response, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey % 100 AS INT) WHEN o_orderkey % 2 = 1 THEN 5 ELSE -1 END AS prompt_eval_count,
  CASE WHEN o_orderkey % 2 = 0 THEN '{"deep":[' || o_orderkey || ',null]}' END AS unknown FROM orders""")
def logs_of_two_versions(spark, sf_dir):
    """Lines of both arms and of changing shape read as one table, written again with a field more, and read back; what no column knows is still there."""
    first, second, k = new_path(spark), new_path(spark), F.col("o_orderkey")
    o = t(spark, sf_dir, "orders")
    model = F.concat(F.lit("m"), (k % 3).cast("string"))
    direct = o.filter(k % 2 == 0).select(
        k.alias("k"), model.alias("model_name"), F.col("o_custkey").alias("question_number"), F.col("o_orderpriority").alias("model_response"), F.when(k % 4 == 0, (F.col("o_custkey") % 100).cast("string")).otherwise("n/a").alias("prompt_eval_count"),
        F.struct(F.array(k, F.lit(None).cast("long")).alias("deep")).alias("unknown"),
    )
    batch = o.filter(k % 2 == 1).select(k.alias("k"), model.alias("model"), F.col("o_custkey").cast("string").alias("q_id"), F.col("o_orderstatus").alias("reduce_answer"), F.struct(F.lit(5).alias("reduce_prompt_eval_count")).alias("ollama"))
    an.append_json(direct, first)
    an.append_json(batch, first)
    read = lambda path: va.varying_answers(va.varying_log(spark, path))
    va.write_varying(read(first).select("arm", "record"), second)
    told = read(second).withColumns({"k": F.variant_get("record", "$.k", "bigint"), "unknown": F.to_json(F.try_variant_get("record", "$.unknown", "variant"))})
    return told.select("k", "arm", "model_name", "question_number", "response", F.coalesce("prompt_eval_count", F.lit(-1)).alias("prompt_eval_count"), "unknown")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 3 END / 10.0 AS faith, (CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 3 END + 2) / 10.0 AS blind, 'look; say: context,response' AS faith_reason, 'say: response,s_suppkey' AS blind_reason FROM supplier")
def judged_by_rubrics(spark, sf_dir):
    """Each metric has its steps and sees only what its rubric shows."""
    cases = t(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")).alias("response"), F.array("s_name").alias("context"), F.lit("secret").alias("gold"))
    rubrics = {"faith": judge.Rubric(("look", "say"), ("response", "context")), "blind": judge.Rubric(("say",), ("s_suppkey", "response"))}
    made = judge.judged(cases, stub_rubric_judge, rubrics)
    return made.select("s_suppkey", F.col("faith").cast("decimal(3,1)").cast("double").alias("faith"), F.col("blind").cast("decimal(3,1)").cast("double").alias("blind"), "faith_reason", "blind_reason")


@query("SELECT s_suppkey, s_name FROM supplier")
def display_columns(spark, sf_dir):
    """of the columns to show those that are there."""
    return an.present_columns(t(spark, sf_dir, "supplier"), ["s_suppkey", "nowhere", "s_name"])


@query("""WITH s AS (SELECT 'a' || o_orderkey % 2 AS arm, CASE WHEN o_custkey % 6 > 0 THEN 'm' || o_custkey % 6 END AS model_name, o_orderkey % 3 = 0 AS judge, o_orderkey % 7 > 0 AS answered, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 101) / 100 END AS f1,
  (o_orderkey % 11) / 10 AS p, (o_orderkey % 13) / 12 AS r, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 9 > 2 END AS correct, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 9 - 4 END AS err, o_orderkey % 17 / 16 AS field, o_orderkey % 2 = 0 AS ok,
  CASE WHEN o_orderkey % 10 > 6 THEN o_orderkey % 10 - 6 ELSE 0 END AS unknown, o_orderkey % 19 = 0 AS leak, CAST(o_orderkey % 23 AS DOUBLE) AS sec, CAST(o_orderkey % 1000 AS INT) AS prompt FROM orders),
g AS (SELECT arm, model_name, count(*) AS questions, count(*) FILTER (WHERE answered) AS answered, avg(f1) AS f1, avg(p) AS p, avg(r) AS r, avg(f1) FILTER (WHERE NOT judge) AS nf1, avg(f1) FILTER (WHERE judge) AS jf1, count(correct) AS scored, avg(CAST(correct AS INT)) AS acc,
  avg(abs(err)) FILTER (WHERE correct IS NOT NULL) AS mae, avg(field) AS field, avg(CAST(ok AS INT)) AS fmt, avg(CAST(unknown > 0 AS INT)) AS made, avg(unknown) AS unk, count(*) FILTER (WHERE leak) AS leaks, avg(sec) AS sec, sum(sec) AS total, min(prompt) AS lo, median(prompt) AS mid, max(prompt) AS hi FROM s GROUP BY 1, 2),
t AS (SELECT *, round_even(0.45 * coalesce(f1, 0) + 0.2 * coalesce(acc, 0) + 0.15 * coalesce(field, 0) + 0.1 * (1 - made) + 0.05 * fmt + 0.05 * answered / questions, 4) AS score FROM g)
SELECT arm, coalesce(model_name, '-') AS model_name, questions, answered, round_even(answered / questions, 4) AS reliability, round_even(f1, 4) AS mean_entity_f1, round_even(p, 4) AS mean_entity_precision, round_even(r, 4) AS mean_entity_recall, round_even(nf1, 4) AS nonjudge_mean_entity_f1, round_even(jf1, 4) AS judge_recommended_mean_entity_f1,
  scored AS count_questions_scored, round_even(acc, 4) AS count_accuracy_rate, round_even(mae, 4) AS mean_abs_count_error, round_even(field, 4) AS field_value_accuracy, round_even(fmt, 4) AS format_core_ok_rate, round_even(made, 4) AS answers_with_unknown_company_mentions_rate, round_even(unk, 4) AS avg_unknown_company_mentions, leaks AS inline_thinking_leak_count,
  round_even(sec, 4) AS avg_runtime_seconds, total AS total_runtime_seconds, lo AS prompt_eval_min, mid AS prompt_eval_median, hi AS prompt_eval_max, score AS research_score_deterministic FROM t""")
def first_version_summary(spark, sf_dir):
    """The first version's model table, its composite included."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    scores = t(spark, sf_dir, "orders").select(
        F.concat(F.lit("a"), (o % 2).cast("string")).alias("arm"), F.when(c % 6 > 0, F.concat(F.lit("m"), (c % 6).cast("string"))).alias("model_name"), (o % 3 == 0).alias("judge_recommended"), (o % 7 > 0).alias("answered"),
        F.when(o % 5 > 0, (o % 101) / 100).alias("entity_f1"), ((o % 11) / 10).alias("entity_precision"), ((o % 13) / 12).alias("entity_recall"), F.when(o % 4 > 0, o % 9 > 2).alias("count_correct"), F.when(o % 4 > 0, o % 9 - 4).alias("count_error"),
        (o % 17 / 16).alias("field_value_accuracy"), (o % 2 == 0).alias("format_core_ok"), F.greatest(o % 10 - 6, F.lit(0)).alias("legacy_unknown_company_mention_count"), (o % 19 == 0).alias("inline_thinking_leak"),
        (o % 23).cast("double").alias("runtime_seconds"), (o % 1000).cast("int").alias("prompt_eval_count"),
    )
    return evaluation.model_summary_v1(scores).withColumn("model_name", F.coalesce("model_name", F.lit("-"))).drop("rank_by_research_score")
