"""Operator 11 against a plain reading of its rule."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from scoreloom.llm import fim


def by_hand(doc_id, text, seed=7, rate=100, suffix_first=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    spm = h4 % 100 < suffix_first
    return len(units), "spm" if spm else "psm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_cuts_equal_plain_python(spark, odd_docs, docs):
    hard = ["a\nb\n<P>c", "<P", ">\n<S>", "<\nP>\n<M\n>", "\n", "\n\n\n", "no end", "ä\n漢字\n😀\n", "<M>", "x<S", "M>y\n", "<<P>>", "\r\n\x0b\n", "<X>\n<p>\n"]
    rows = [(1000 + 20 * k + i, t) for k, t in enumerate(hard) for i in range(20)] + [(10**18 + 1, "a\nb\nc\n" * 5), (-5, "a\nb\n")]
    for df in (odd_docs, docs, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)):
        out = fim.fill_in_middle(df).withColumn("back", fim.restored(F.col("output"), F.col("form")))
        got = sorted(([r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output] for r in out.collect()), key=repr)
        want = sorted(([r.doc_id, *by_hand(r.doc_id, r.text)] for r in df.collect()), key=repr)
        assert got == want
        assert sorted(r.back for r in out.collect()) == sorted(r.text or "" for r in df.collect())


def test_rates_and_steps(docs, monkeypatch):
    few = fim.fill_in_middle(docs, rate=30, suffix_first=80, seed=3).collect()
    want = {r.doc_id: by_hand(r.doc_id, r.text, 3, 30, 80) for r in docs.collect()}
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want[r.doc_id] for r in few)
    assert {r.form for r in few} == {"plain", "psm", "spm"}


def test_one_call_takes_all_rows_together():
    texts = ["a\nb\nc", "", "\n", "x<P>", "é\n", ""]
    data = "".join(texts).encode()
    at = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    draws = np.array([[1, 0, 0, 0, 1, 0], [3, 0, 1, 0, 0, 0], [0] * 6, [60] * 6])
    n, form, ahead, inside, out, borders = fim.rearranged(np.frombuffer(data, np.uint8), at, draws)
    assert n.tolist() == [3, 0, 1, 1, 1, 0] and fim.FORMS[form].tolist() == ["psm", "plain", "psm", "plain", "psm", "plain"]
    assert ahead[[0, 2, 4]].tolist() == [2, 0, 0] and inside[[0, 2, 4]].tolist() == [3, 1, 2]
    made = [out[a:b].tobytes().decode() for a, b in zip(borders[:-1], borders[1:])]
    assert made == ["<P>a\n<S><M>b\nc", "", "<P><S><M>\n", "x<P>", "<P><S><M>é\n", ""]


def test_no_rows_and_clashing_columns(no_docs, odd_docs):
    assert fim.fill_in_middle(no_docs).count() == 0
    clash = odd_docs.selectExpr("doc_id", "text", "1 AS n", "'x' AS form", "'y' AS output", "2 AS h0", "3 AS id")
    assert fim.fill_in_middle(clash).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fim.fill_in_middle(clash).count() == odd_docs.count()
