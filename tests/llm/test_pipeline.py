"""The pipeline's stages on their own input, and the whole of it against brute force."""

import importlib
import math
import re
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from scoreloom.llm import common, importance, packing, quality_rules  # noqa: E402

from .test_jaccard import smallest_ids  # noqa: E402
from .test_pages_media_packing import plain_best_fit  # noqa: E402
from .test_text_operators import rule_counts  # noqa: E402


def plain_rules(text):
    """The production table's verdict in plain Python."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tidy = [x.strip(" \t\n\x0b\x0c\r") for x in lines]
    n, chars, symbols, again, repeated = rule_counts(text)
    m = {
        "one": 1, "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": again, "n_repeat_words": repeated, "n_lines": len(lines),
        "n_stop_words": sum(w.lower() in quality_rules.STOP_WORDS for w in words), "n_bullet_lines": sum(x[:1] in quality_rules.BULLETS for x in tidy),
        "n_ellipsis_lines": sum(x.endswith(("...", "…")) for x in tidy),
    }
    broken = any(
        (r.low is not None and m[r.part] * 1000 < m[r.whole] * r.low) or (r.high is not None and m[r.part] * 1000 > m[r.whole] * r.high) for r in quality_rules.RULES
    )
    return not (n < 20 or 100 * repeated > 30 * n or broken)


def plain_weights(texts, good):
    """Log weights by counting n-grams of all texts and of the good ones."""
    size = importance.BUCKETS
    grams = [importance.features(t) for t in texts]
    raw = np.bincount(np.concatenate(grams), minlength=3 * size).reshape(3, size)
    target = np.bincount(np.concatenate([g for g, x in zip(grams, good) if x]), minlength=3 * size).reshape(3, size)
    ratios = []
    for a, b in zip(raw, target):
        p = (a + 0.5) / (a.sum() + 0.5 * size)
        ratios.append(np.log((b + size / 8 * p) / (b.sum() + size / 8) / p))
    ratios = np.concatenate(ratios)
    return [importance.SHARPNESS * ratios[g].mean() if len(g) else 0.0 for g in grams]


def test_run_equals_brute_force(spark, sf, tmp_path):
    """The whole pipeline in plain Python: weights, noise and the k largest keys; rules; all pairs; every bin."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    words = next(r for r in sorted(rows, key=lambda r: r.doc_id) if 150 < len(r.text.split()) < 400 and plain_rules(r.text)).text.split()
    near = {90_000 + k: " ".join(words[: 20 * k] + [f"new{k}"] + words[20 * k + 1 :]) for k in range(1, 6)}  # planted near copies
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows] + [(i, t, "en", "planted", len(t)) for i, t in near.items()]
    folder = f"{tmp_path}/tables"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    told = {r.doc_id: r.quality for r in labels.collect()}
    text = {d[0]: d[1] for d in docs}

    weights = dict(zip(text, plain_weights(list(text.values()), [told.get(i) == 1 for i in text])))
    made = {r.doc_id: r for r in importance.resample(spark.read.parquet(f"{folder}/documents.parquet"), labels).collect()}
    assert all(abs(made[i].score - w) < 1e-6 for i, w in weights.items())
    k = math.ceil(importance._share(sum(q == 1 for q in told.values()), len(told)) * len(text))
    best = sorted(text, key=lambda i: -(weights[i] + made[i].key - made[i].score))[:k]
    ruled = {i: text[i] for i in best if plain_rules(text[i])}
    stay = {i for i, first in smallest_ids(ruled).items() if i == first}

    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == stay and len(stay) < len(ruled)
    sources = {d[0]: d[3] for d in docs}
    for shard in {r.shard for r in got}:
        last = sorted((r for r in got if r.shard == shard and r.bin >= 0), key=lambda r: (-r.size, r.doc_id))
        bits = {s: 1 << n for n, s in enumerate(sorted({sources[r.doc_id] for r in last}))}
        assert [r.bin for r in last] == plain_best_fit([r.size for r in last], [bits[sources[r.doc_id]] for r in last], packing.CAPACITY)
    for i in stay:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text[i]))
        mine = [r for r in got if r.doc_id == i]
        assert sum(r.size for r in mine) == n and all(r.size == packing.CAPACITY for r in mine if r.bin < 0)


def test_stages_hold_on_odd_and_empty_tables(spark, sf, odd_docs, no_docs):
    for df in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, sf)
            assert out.count() <= df.count() or name == "best_fit_packing"
            if name != "best_fit_packing":
                assert out.columns == df.columns


def test_clean_documents_stay(spark):
    """Each filtering stage keeps good documents, judged on its own input; near-dedup keeps one of each group."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    whole = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = {r.doc_id for r in docs.collect()}
        docs = common.written(stage(spark, docs, sf), name)
        kept = {r.doc_id for r in docs.collect()}
        if name == "simhash_near_dedup":
            break
        lost = {i for i in (good & before) - kept if name != "quality_rules" or rule_counts(whole[i])[0] >= 20}  # shorter ones fail the base rule
        assert len(lost) <= 0.02 * len(good & before), name
    assert kept == {i for i, first in smallest_ids({i: whole[i] for i in before}).items() if i == first}


def test_registered_queries():
    entry = importlib.import_module("__spark_entry__")
    names = Counter(n.split("_")[0] for n in entry.queries() if n.startswith("op"))
    assert all(names[f"op{k}"] == 1 for k in range(1, 11))
    assert "pipeline" in entry.queries() and "op1_quality_rules" in entry.oracle_sql()
