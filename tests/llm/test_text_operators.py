"""Operators 1, 6, 7 and 8 against plain Python, on odd tables and real documents."""

import hashlib
import random
import re
from array import array
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import tiktoken
import xxhash

from scoreloom.llm import bpe, graph, jaccard, quality_rules, simhash, wordpiece


def rule_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules_equal_plain_python(odd_docs, docs):
    for df in (odd_docs, docs):
        rows = quality_rules.quality_rules(df).collect()
        assert len(rows) == df.count()
        for r in rows:
            n, *rest = want = rule_counts(r.text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (n < 20 or 100 * rest[-1] > 30 * n)
            assert not (r.base_failed and r.kept)
            assert r.kept or r.base_failed or r.failed_rules


def test_rules_keep_good_and_drop_junk(spark, docs, sf):
    rows = quality_rules.quality_rules(docs).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert not any(r.kept for r in rows if r.quality == 0)


def test_rules_on_no_rows_and_columns(odd_docs, no_docs):
    assert quality_rules.quality_rules(no_docs).count() == 0
    assert quality_rules.passing(odd_docs).columns == odd_docs.columns
    clash = quality_rules.quality_rules(odd_docs.selectExpr("text", "7 AS `__judged`", "8 AS kept", "9 AS `a.b`")).collect()
    assert all(r["__judged"] == 7 and r.kept in (True, False) and r["a.b"] == 9 for r in clash) and len(clash) == odd_docs.count()
    plan = quality_rules.quality_rules(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_word_pieces_equal_trying_all_lengths():
    rand = random.Random(5)
    for _ in range(500):
        pieces = {"".join(rand.choices("abc", k=rand.randint(1, 5))) for _ in range(rand.randint(1, 12))}
        machine = wordpiece.LongestMatch(pieces)
        for _ in range(10):
            word = "".join(rand.choices("abcdé", k=rand.randint(0, 20)))
            assert machine.count(word) == wordpiece.greedy_pieces(word, pieces, 5)


def test_token_counts(odd_docs, no_docs, docs):
    pieces = set(wordpiece.read_vocabulary(wordpiece.default_vocabulary()))
    longest = max(map(len, pieces))
    for df in (odd_docs, docs.limit(40)):
        texts = Counter((r.doc_id, r.text) for r in df.collect())
        want = Counter()
        for (i, x), n in texts.items():
            words = [w for w in re.split(r"[\x20\x09-\x0D]+", x or "") if w]
            want[i, len(words), sum(wordpiece.greedy_pieces("▁" + w, pieces, longest) for w in words)] += n
        assert Counter(map(tuple, wordpiece.token_counts(df).collect())) == want
    assert wordpiece.token_counts(no_docs).count() == 0


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    near = defaultdict(set)
    for i, (a, fa) in enumerate(pairs):
        for b, fb in pairs[i:]:
            if (fa ^ fb).bit_count() <= 4:
                near[a].add(b)
                near[b].add(a)
    out = {}
    for a in sorted(x for x, _ in pairs):
        if a not in out:
            todo = [a]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = a
                    todo += near[x]
    return out


def test_fingerprints_equal_plain_python(odd_docs, docs):
    for df in (odd_docs, docs.limit(60)):
        for r in df.select("text").distinct().collect():
            if len(r.text or "") < 20_000:
                assert simhash.fingerprint(r.text) == plain_fingerprint(r.text)


def test_near_duplicates_equal_all_pairs(docs, odd_docs, no_docs):
    for df, bucket in ((docs, 4096), (docs, 2), (odd_docs.filter("doc_id is not null"), 4096)):
        rows = simhash.near_duplicates(df, bucket=bucket).collect()
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in df.select("doc_id").collect())
        want = plain_components(sorted({(r.doc_id, int(r.fingerprint, 16)) for r in rows}))
        assert all(r.component_id == want[r.doc_id] for r in rows)
    assert simhash.near_duplicates(no_docs).count() == 0
    with_null = simhash.near_duplicates(odd_docs).collect()
    assert len(with_null) == odd_docs.count()
    assert {r.component_id for r in with_null if r.doc_id is None} <= {3, None}


def test_dense_ball_of_fingerprints_is_one_component(spark):
    """Fingerprints that differ in few bits and share most buckets: forests, not pairs, and a second index level."""
    centre = 0x0123456789ABCDEF
    fps = sorted({centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a, 64)} | {centre ^ 0xFFFFFFFF00000000})
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    found = graph.components(simhash.links(df, bucket=100)).collect()
    assert len({r.label for r in found}) == 1 and len(found) == len(fps) - 1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "u long, v long")
    found = {r.node: r.label for r in graph.components(edges).collect()}
    assert found == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_one_of_each_keeps_columns_and_one_row_a_group(odd_docs, docs):
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[0] == 1 and ids[1] == 0 and ids[10] == 1 and ids[None] == 1  # one null id stands for its own text
    whole = simhash.near_duplicates(docs)
    assert simhash.one_of_each(docs).count() == whole.select("component_id").distinct().count()


def test_one_row_of_rows_that_share_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a, "x"), (3, b, "x"), (5, b, "y"), (7, a, "x"), (9, "c " * 30, "p"), (9, "c " * 30, "q"), (9, "c " * 30, "p"), (None, a, "z"), (None, "only " * 9, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for near in (simhash.groups, jaccard.groups):
        kept = Counter((r.doc_id, r.text) for r in simhash.one_of_each(df, near=near).collect())
        assert kept == {(5, a): 1, (3, b): 1, (9, "c " * 30): 1, (None, "only " * 9): 1}
        again = simhash.one_of_each(df.repartition(3), near=near)
        assert sorted(map(repr, again.collect())) == sorted(map(repr, simhash.one_of_each(df, near=near).collect()))


def test_a_bucket_of_very_many_fingerprints(spark):
    """Thousands of distinct fingerprints that agree in 40 bits, over the bound of a bucket: links as by all pairs."""
    rand = np.random.default_rng(6)
    fps = np.unique(rand.integers(0, 1 << 24, 6_000, np.uint64) << np.uint64(10) | np.uint64(0x5A5A5A0000000155))
    planted = np.unique(fps[:50] ^ (np.uint64(1) << rand.integers(40, 60, 50).astype(np.uint64)))
    df = spark.createDataFrame(pd.DataFrame({"fp": np.concatenate((fps, planted)).view(np.int64)})).distinct()
    sample = np.concatenate((fps[:200], planted))
    labels = {r.node: r.label for r in graph.components(simhash.links(df, bucket=1000)).collect()}
    dealt = {r.node: r.label for r in graph.components(simhash.links(df, bucket=1000, block=150)).collect()}
    assert dealt == labels  # as well over many tasks
    every = np.concatenate((fps, planted))
    for f in sample:
        near = every[np.bitwise_count(every ^ f) <= 4].view(np.int64).tolist()
        assert len({labels.get(x, x) for x in near}) == 1


def test_a_hundred_thousand_fingerprints_in_one_bucket_need_little_memory(monkeypatch):
    """A dense group of 100,000: a forest in few steps, each over at most STEP fingerprints."""
    rand = np.random.default_rng(7)
    near = [np.uint64(0)] + [rand.integers(0, 64, 100_000).astype(np.uint64) for _ in range(4)]
    fps = np.full(100_000, 0x0123456789ABCDEF, np.uint64)
    for bits in near[1:]:
        fps ^= np.uint64(1) << bits
    fps = np.unique(np.append(fps, np.uint64(0x0123456789ABCDEF)))
    sizes, count = [], np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: sizes.append(x.size) or count(x))
    group = simhash.near_groups(fps)
    assert len(np.unique(group)) == 1 and max(sizes) <= 64 * simhash.STEP


def test_bpe_equals_the_rank_files_library():
    ranks = bpe.read_ranks(bpe.default_ranks())
    enc = bpe.encoder(bpe.default_ranks())
    want = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    rand, tokens = random.Random(2), list(ranks)
    for k in range(3000):
        piece = b"".join(rand.choices(tokens, k=rand.randint(1, 5))) if k % 2 else bytes(rand.choices(b"aaar nth\xc3\xa9", k=rand.randint(1, 40)))
        ids = enc.encode(piece)
        assert ids == want._encode_single_piece(piece) and enc.decode(ids) == piece


def test_bpe_appends_and_edits_go_on_from_the_stored_prefixes():
    enc = bpe.encoder(bpe.default_ranks())
    whole = b"internationalisierung rrrrrr des textes"
    for cut in range(len(whole)):
        assert enc.last_tokens(whole, enc.last_tokens(whole[:cut])) == enc.last_tokens(whole)
        other = whole[:cut] + b"zq" + whole[cut:]
        assert enc.edited(whole, enc.last_tokens(whole), other) == enc.last_tokens(other)
    rand = random.Random(3)
    for _ in range(60):
        text = bytes(rand.choices(b"aaar nth\xc3\xa9the ing", k=2000))
        at, gone = rand.randrange(1900), rand.randint(0, 9)
        other = text[:at] + bytes(rand.choices(b"xyz the", k=rand.randint(0, 9))) + text[at + gone :]
        assert enc.edited(text, enc.last_tokens(text), other) == enc.last_tokens(other)


def test_an_edit_costs_no_more_than_its_surroundings(monkeypatch):
    enc = bpe.encoder(bpe.default_ranks())
    text = b"the rain in spain stays mainly in the plain " * 200
    last, other = enc.last_tokens(text), text[:100] + b"zq" + text[103:]
    want, looked = enc.last_tokens(other), []
    work = enc.last_tokens
    monkeypatch.setattr(enc, "last_tokens", lambda piece, known=None: looked.append(len(piece)) or work(piece, known))
    assert enc.edited(text, last, other) == want and max(looked) < 100 + 5 * enc.longest < len(text)


def test_bpe_rows(odd_docs, no_docs):
    want = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.read_ranks(bpe.default_ranks()), special_tokens={})
    texts = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()): r.text or "" for r in odd_docs.collect()}
    rows = bpe.bpe_digests(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        ids = want.encode_ordinary(texts[r.doc_id, r.decoded_sha256])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
    assert bpe.bpe(no_docs).count() == 0
    assert {bytes(r.decoded).decode() for r in bpe.bpe(odd_docs).collect()} == set(texts.values())
