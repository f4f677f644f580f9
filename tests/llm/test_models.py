"""Operators 2, 3 and 5: plain Python, held-out accuracy, and odd tables."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scoreloom.llm import common, importance, langid, simhash, toxicity

BIG = "/root/testdata/sf0.01"


@pytest.mark.parametrize("ids", [lambda i: 1, lambda i: None, lambda i: i, lambda i: i % 3])
def test_samples_never_fall_short(spark, ids):
    df = spark.createDataFrame([(ids(i), f"text {i % 900}", "a" if i % 50 else "b") for i in range(1000)], "i long, t string, k string").repartition(5)
    n = df.distinct().count()
    got = common.hash_sample(df, 10, "x")
    assert got.count() == 10 == got.distinct().count() and got.columns == df.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, common.hash_sample(df.repartition(2), 10, "x").collect()))
    assert common.hash_sample(df, 5000, "x").count() == n
    per = Counter(r.k for r in common.hash_sample(df, 15, "x", by="k").collect())
    assert per["a"] == 15 and per["b"] == min(15, df.filter("k = 'b'").distinct().count())
    assert common.hash_sample(df.limit(0), 5, "x").count() == 0 == common.hash_sample(df.limit(0), 5, "x", by="k").count()


def plain_vectors(texts, buckets):
    found = Counter(b for t in texts for b in np.flatnonzero(langid.counts(t, buckets)).tolist())
    idf = [math.log((1 + len(texts)) / (1 + found[b])) + 1 for b in range(buckets)]
    out = []
    for t in texts:
        c = langid.counts(t, buckets)
        x = {b: (1 + math.log(c[b])) * idf[b] for b in np.flatnonzero(c).tolist()}
        length = math.sqrt(sum(v * v for v in x.values())) or 1.0
        out.append({b: v / length for b, v in x.items()})
    return out


def plain_ftrl(vectors, y, n_langs, bias, order):
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        if abs(z[k]) <= langid.L1:
            return 0.0
        return -(z[k] - math.copysign(langid.L1, z[k])) / ((langid.BETA + math.sqrt(n[k])) / langid.ALPHA + langid.L2)

    for i in order:
        x = {**vectors[i], bias: 1.0}
        w = {(b, c): weight((b, c)) for b in x for c in range(n_langs)}
        e = [math.exp(sum(v * w[b, c] for b, v in x.items())) for c in range(n_langs)]
        for c in range(n_langs):
            p = e[c] / sum(e) - (y[i] == c)
            for b, v in x.items():
                g, k = v * p, (b, c)
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / langid.ALPHA * w[k]
                n[k] += g * g
    return {k: weight(k) for k in z}


def test_language_model_equals_plain_python(spark):
    rand = random.Random(4)
    words = {"x": "lorem ipsum dolor sit amet elit".split(), "y": "über straße nicht auch wären für".split(), "z": "que los niños está año más".split()}
    rows = [(i, " ".join(rand.choices(words[k], k=rand.randint(3, 12))) + f" n{i}", k) for i, k in enumerate(rand.choices("xyz", k=60))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, buckets=64)
    rows.sort(key=lambda r: np.array(xxhash.xxh64_intdigest(r[1].encode(), 42), np.uint64).astype(np.int64))  # Spark's xxhash64
    vectors = plain_vectors([r[1] for r in rows], 64)
    langs = sorted({r[2] for r in rows})
    y = [langs.index(r[2]) for r in rows]
    group = simhash.near_groups(np.array([simhash.fingerprint(r[1]) for r in rows], np.uint64), langid.NEAR_BITS)
    order = np.random.default_rng(7).permutation(60)
    held = {i for i in range(60) if group[i] in {group[j] for j in order[:6]}}
    train = [i for i in order if i not in held]
    want = plain_ftrl(vectors, y, 3, 64, [i for k in range(langid.EPOCHS) for i in np.random.default_rng(k).permutation(train)])
    for (b, c), w in want.items():
        assert abs(model.weights[b, c] - w) < 1e-9
    assert np.count_nonzero(model.weights) == sum(w != 0 for w in want.values())

    def loss(t):
        total = 0.0
        for i in held:
            z = [(sum(v * want.get((b, c), 0.0) for b, v in vectors[i].items()) + want[64, c]) / t for c in range(3)]
            share = [(len(held) + 1) / (len(held) + 2) if c == y[i] else 1 / (len(held) + 2) / 2 for c in range(3)]
            total += math.log(sum(map(math.exp, z))) - sum(a * b for a, b in zip(share, z))
        return total

    assert abs(loss(model.temperature) - min(loss(t) for t in np.geomspace(0.05, 20, 121))) < 1e-9


def test_rare_languages_are_learnt(spark):
    rows = [(i, f"plain english words number {i} and the rest of it", "en") for i in range(5000)] + [(9000 + i, f"þetta er íslenska og ekkert annað {i}", "is") for i in range(5)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_fit=200)
    assert model.langs == ("en", "is") and model.predict("íslenska er þetta")[0] == "is"


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(odd_docs, no_docs):
    rows = langid.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == got[12].lang_pred == "und" and got[12].score == 0
    assert {r.lang_pred for r in rows} <= {"und", "en", "de", "fr"}
    assert langid.identify(no_docs).count() == 0
    unlearnt = langid.predicted(odd_docs, None).collect()
    assert {r.lang_pred for r in unlearnt} == {"und"}


def test_language_counts_do_not_depend_on_blocks(monkeypatch):
    text = "Ein  Satz, der\n\nvon Block zu Block geht. " * 40
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert (langid.counts(text) == whole).all()


def test_toxicity_on_documents_it_was_not_fitted_on(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fit_on = labels.filter("doc_id % 4 <> 0")
    chain = toxicity.fit(docs, fit_on)
    rows = toxicity.predicted(docs, chain).join(labels.filter("doc_id % 4 = 0"), "doc_id").collect()
    hits = sum(r.is_toxic and r.toxic == 1 for r in rows)
    assert hits / sum(r.is_toxic for r in rows) > 0.9 and hits / sum(r.toxic for r in rows) > 0.8
    # later models see the earlier categories
    assert np.abs(chain.weights[1, len(chain.words) : -1]).sum() > 0


def plain_chain(texts, ys, counts, folds):
    """The chain in plain Python: dictionaries and loops over rows."""
    own = [toxicity.features(t) for t in texts]
    often = {f for fs in own for f in fs}
    sigmoid = lambda z: 1 / (1 + math.exp(-max(-40, min(40, z))))

    def used(rows, y):
        n, pos, out = len(rows), sum(y), set()
        for f in often:
            a = sum(f in fs for fs in rows)
            b = sum(v for fs, v in zip(rows, y) if f in fs)
            g = 0.0
            for got, due in ((b, a * pos / n), (a - b, a * (n - pos) / n), (pos - b, (n - a) * pos / n), (n - pos - a + b, (n - a) * (n - pos) / n)):
                g += 2 * got * math.log(max(got, 1e-12) / max(due, 1e-12))
            if g >= toxicity.TELLING:
                out.add(f)
        return out

    def train(rows, extra, y, part):
        if min(y) == max(y):
            return Counter(), [0.0] * len(extra[0]), 6.0 if y[0] else -6.0
        keep = used(rows, y)
        part = [p / sum(part) for p in part]
        mean = sum(p * v for p, v in zip(part, y))
        keys = [*sorted(keep), *range(len(extra[0])), None]
        w, size = dict.fromkeys(keys, 0.0), dict.fromkeys(keys, 1e-8)
        w[None] = math.log(mean / (1 - mean))
        for _ in range(toxicity.ROUNDS):
            g = dict.fromkeys(keys, 0.0)
            for fs, e, v, p in zip(rows, extra, y, part):
                error = (sigmoid(sum(w[f] for f in fs & keep) + sum(a * w[j] for j, a in enumerate(e)) + w[None]) - v) * p
                for f in fs & keep:
                    g[f] += error
                for j, a in enumerate(e):
                    g[j] += error * a
                g[None] += error
            for k in keys:
                step = g[k] + (toxicity.PENALTY * w[k] if k is not None else 0.0)
                size[k] += step * step
                w[k] -= toxicity.STEP * step / math.sqrt(size[k])
        return Counter({f: w[f] for f in keep}), [w[j] for j in range(len(extra[0]))], w[None]

    say = lambda m, fs, e: sigmoid(sum(m[0][f] for f in fs) + sum(a * b for a, b in zip(e, m[1])) + m[2])
    extra, out = [[] for _ in texts], [[] for _ in texts]
    for y in zip(*ys):
        held = [0.0] * len(texts)
        for f in set(folds):
            inside = [i for i in range(len(texts)) if folds[i] != f]
            m = train([own[i] for i in inside], [extra[i] for i in inside], [y[i] for i in inside], [counts[i] for i in inside])
            for i in range(len(texts)):
                if folds[i] == f:
                    held[i] = say(m, own[i], extra[i])
        m = train(own, extra, y, counts)
        for i, p in enumerate([say(m, own[i], [q - 0.5 for q in out[i]]) for i in range(len(texts))]):
            out[i].append(p)
        extra = [[*e, h - 0.5] for e, h in zip(extra, held)]
    return out


def test_chain_equals_plain_python(spark):
    """Three categories; labels of one id that differ; near copies in one fold; a combination with more rows than drawn."""
    rand = random.Random(9)
    common_words, rude, bad = [f"w{i}" for i in range(40)], ["idiot", "clown", "pathetic"], ["spam", "click", "cheap"]
    texts, labels = [], []
    for i in range(90):
        a, b = rand.random() < 0.4, rand.random() < 0.3
        words = rand.choices(common_words, k=25) + (rand.choices(rude, k=2) if a else []) + (rand.choices(bad, k=2) if b else []) + [f"own{i}"]
        rand.shuffle(words)
        texts.append(" ".join(words))
        labels.append((i, int(a), int(b), int(a and b or rand.random() < 0.05)))
    texts[1] = texts[0] + " more"
    told = [*labels, (5, 1, 0, 0), (6, None, None, None), (None, 1, 1, 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    three = (("rude", "a = 1"), ("junk", "b = 1"), ("both", "c = 1"))
    chain = toxicity.fit(docs, spark.createDataFrame(told, "doc_id long, a int, b int, c int"), categories=three)
    labels[5] = (5, 1, *labels[5][2:])
    order = sorted(range(90), key=lambda i: np.array(xxhash.xxh64_intdigest(texts[i].encode(), 42), np.uint64).astype(np.int64))
    hashes = np.array([np.array(xxhash.xxh64_intdigest(texts[i].encode(), 42), np.uint64).astype(np.int64) for i in order])
    prints = np.array([simhash.fingerprint(texts[i]) for i in order], np.uint64)
    folds = toxicity.folds_of(hashes, prints, toxicity.FOLDS).tolist()
    want = plain_chain([texts[i] for i in order], [labels[i][1:] for i in order], [1.0] * 90, folds)
    for i, p in zip(order, want):
        assert np.allclose(chain.predict(texts[i]), p, atol=1e-9, rtol=0)


def test_near_copies_are_in_one_fold():
    prints = np.array([0, 1, 3, 1 << 40, (1 << 40) | 1, 0xFFFF << 20, 0xFFFF << 20], np.uint64)
    folds = toxicity.folds_of(np.arange(7), prints, 2)
    assert folds[0] == folds[1] == folds[2] and folds[3] == folds[4] and folds[5] == folds[6] and len(set(folds.tolist())) == 2


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(12)] + [(None, 1, 1), (3, None, None), (5, 0, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for told in (labels, none):
        rows = toxicity.toxicity(odd_docs, told).collect()
        assert len(rows) == odd_docs.count()
        assert all(0 <= r.p_toxic <= 1 for r in rows)
    assert not any(r.is_toxic for r in toxicity.toxicity(odd_docs, none).collect() if r.p_toxic < 0.5)
    assert toxicity.toxicity(no_docs, labels).count() == 0


def test_importance_keeps_good_and_drops_junk(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    rows = importance.resample(docs, labels).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert np.mean([r.kept for r in good]) > 0.99 and np.mean([r.kept for r in bad]) < 0.35


def test_importance_scores_equal_plain_counting(docs, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = importance.fit(docs, labels, buckets=256)
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    raw, target = np.zeros(768), np.zeros(768)
    for r in docs.collect():
        for f in importance.features(r.text, 256).tolist():
            raw[f] += 1
            target[f] += r.doc_id in good
    for k in range(3):
        a, b = raw[k * 256 : k * 256 + 256], target[k * 256 : k * 256 + 256]
        p = (a + 0.5) / (a.sum() + 128)
        q = (b + 32 * p) / (b.sum() + 32)
        assert np.allclose(model.ratios[k * 256 : k * 256 + 256], np.log(q / p))


def test_good_documents_that_the_fit_did_not_see(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = importance.resample(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert np.mean([r.kept for r in good]) > 0.99 and np.mean([r.kept for r in bad]) < 0.2
    # Among good documents the noise (standard deviation 1.28) decides more than the weight; others are far below.
    spread = np.quantile([r.score for r in good], [0.1, 0.5, 0.9])
    assert spread[2] - spread[0] < 2 and np.median([r.score for r in bad]) < spread[1] - 15


def test_noise_is_gumbel_noise(docs, spark, sf):
    rows = importance.resample(docs, spark.read.parquet(f"{sf}/labels.parquet"), share=0.4).collect()
    noise = [r.key - r.score for r in rows]
    assert abs(np.mean(noise) - 0.5772) < 0.3 and abs(np.std(noise) - 1.2825) < 0.3


def test_share_of_good_labels():
    assert importance._share(0, 0) == importance._share(0, 9) == 1.0
    assert 0.5 < importance._share(50, 100) < 0.63 and 0.5 < importance._share(500_000, 1_000_000) < 0.502


def test_top_k_is_exact_and_repeatable(docs, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = importance.resample(docs, labels, share=0.3).collect()
    k = int(np.ceil(0.3 * len(rows)))
    best = {r.doc_id for r in sorted(rows, key=lambda r: -r.key)[:k]}
    assert {r.doc_id for r in rows if r.kept} == best
    assert {r.doc_id for r in importance.sampled(docs, labels, share=0.3).collect()} == best


def test_kth_largest_against_sorting(spark):
    rand = np.random.default_rng(1)
    for values in (rand.normal(size=500), np.repeat([1.5, -2.0, 7.25], 40), np.array([0.0]), np.nextafter(1.0, 2.0) ** np.arange(30), np.exp(rand.normal(size=300) * 20)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        for k in (1, len(values) // 3 or 1, len(values), len(values) + 5):
            assert importance.kth_largest(df, "v", k) == sorted(values)[::-1][min(k, len(values)) - 1]
    assert importance.kth_largest(df, "v", 0) is None and importance.kth_largest(df.limit(0), "v", 3) is None


def test_importance_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (1, 1), (10, 1), (None, 1), (11, 0), (3, None)], "doc_id long, quality int")
    rows = importance.resample(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(r.score == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert importance.sampled(odd_docs, labels).columns == odd_docs.columns
    assert importance.resample(odd_docs, labels.limit(0)).filter("kept").count() == odd_docs.count()
    assert importance.sampled(no_docs, labels).count() == 0
    assert importance.resample(odd_docs, labels, share=0.0).filter(F.col("kept")).count() == 0
