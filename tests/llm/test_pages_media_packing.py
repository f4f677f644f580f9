"""Operators 4, 9 and 10."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from html import unescape
from itertools import product

import numpy as np
import pytest

from scoreloom.llm import html_extract, media, packing
from scoreloom.llm.common import new_path

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body class="has-sidebar">
<header><a href="/">Logo</a> <p>Site header text that goes on for some words.</p></header>
<nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies. <button>OK</button></p></div>
<div id="sidebar"><h3>Related</h3><p>Some long sidebar paragraph with many plain words in it, no links at all.</p></div>
<article><h1>The &amp; title</h1><p>First&nbsp;paragraph   with <b>bold</b>
and <a href="/x">a link</a>.<p>Second &#8212; one<br>more.</p><ul><li>Item</li></ul>
<form><label>Mail</label><input name=m></form><aside class="ad">Buy now</aside>
<section class="comments"><p>A reader says a lot of words here, in a long comment with sentences.</p></section></article>
<footer>&copy; somebody</footer></body></html>"""


def test_main_text_of_a_page():
    want = ["The & title", "First paragraph with bold and a link.", "Second — one more.", "Item"]
    assert html_extract.main_text(PAGE).split("\n\n") == want


@pytest.mark.parametrize("page", ["", None, "<", "<p", "<p>a < b && c</p", "plain words without any markup at all here", "<script>x", "<!-- open", "<div " * 50, "</p></div>", "<p title=\"a>b\">q</p>"])
def test_broken_pages_give_some_text(page):
    assert isinstance(html_extract.main_text(page), str)


LONG = "A long paragraph of plain prose that goes on, with commas and with full stops. It has several sentences, as articles have."
LAYOUTS = {  # page -> the blocks that are its main text
    f'<div class="content with-sidebar"><p>{LONG}</p></div>': [LONG],
    f'<div class="post has-header-image"><p>{LONG}</p></div>': [LONG],
    f'<main><p>{LONG}</p><section><article class="comment"><p>{LONG} by a reader</p></article></section></main>': [LONG],
    f'<div id="main"><p>{LONG}</p><div id="comments"><article><p>{LONG} by a reader</p></article></div></div>': [LONG],
    f'<article><p>{LONG}</p><div class="ad">{LONG} Buy.</div><p>{LONG}</p></article>': [LONG, LONG],
    f'<article><p>Here <math><mi>x</mi></math> is one. {LONG}</p></article>': [f"Here x is one. {LONG}"],
    f'<form id="aspnetForm"><div class="nav"><a href=x>Menu</a></div><article><p>{LONG}</p></article></form>': [LONG],
    f'<div class="topnav"><a href=/>Home</a> <a href=/b>B</a></div><div><h1>A title</h1><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div><div class="footer">© 2020 Foo | Legal</div>': ["A title", LONG, "Short one.", LONG],
    f"<table><tr><td><a href=/>Home</a><br><a href=/b>About</a></td><td><h2>Head line</h2>{LONG}<p>{LONG}</td></tr></table>": ["Head line", LONG, LONG],
    f'<article><header class="entry-header"><h1>Head</h1></header><p>{LONG}</p><footer>Filed under X</footer></article>': ["Head", LONG],
    f"<main><p>{LONG}</p><aside><p>{LONG} Aside.</p></aside></main>": [LONG],
    f"<div id=content><p>{LONG}</p><p>{LONG}</p><h3>Related stories</h3><ul><li><a href=x>One story</a><li><a href=y>Two story</a></ul></div>": [LONG, LONG],
    f'<div role="navigation"><p>{LONG} Menu.</p></div><div role="main"><p>{LONG}</p></div>': [LONG],
    f'<article><p title="class=hidden ad">{LONG}</p><p hidden>{LONG} Hidden.</p></article>': [LONG],
    f"<article><p>a < b && c > d {LONG}</p></article>": [f"a < b && c > d {LONG}"],
}


@pytest.mark.parametrize("page", LAYOUTS)
def test_layouts(page):
    assert html_extract.main_text(page).split("\n\n") == LAYOUTS[page]


@pytest.mark.parametrize("page", [
    "<a " + "\"'" * 50_000, '<a x="' * 50_000, "<div>" * 100_000 + "deep", "<a " * 100_000, "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000, '<a x=">" ' * 50_000,
    "<!-- " * 100_000, "<div>" * 30_000 + "</p></span></td>" * 30_000, "< " * 100_000, "<ul><li>x" * 20_000,
])
def test_bad_pages_take_time_in_proportion(page):
    began = time.perf_counter()
    html_extract.main_text(page)
    assert time.perf_counter() - began < 3  # under one when nothing else runs


def test_cut_can_turn_what_class_words_say():
    """A paragraph of an article whose name says footer stays with its neighbours; an advert does not."""
    page = f'<article><p>{LONG}</p><p class="footer-of-story">{LONG} And on.</p><p>{LONG}</p><p class="ads">{LONG} Buy.</p></article>'
    assert html_extract.main_text(page).split("\n\n") == [LONG, f"{LONG} And on.", LONG]


def test_class_words():
    said = html_extract.class_words
    assert said("content with-sidebar") > 0 and said("post no-comments") > 0 and said("comment-body") == said("adSlot") == -1 and said("sidebar") == -1
    assert -1 < said("main-footer") < said("footer-text") < 0 == said("") == said("x1 grid")


def test_fit_learns_from_pages_with_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    model = html_extract.fit(pages)
    assert model.weights[1] < 0 and not np.allclose(model.weights, html_extract.LEAN)
    assert html_extract.fit(pages.limit(0)) is html_extract.NO_MODEL


def test_cut_equals_trying_all_labellings():
    rand = random.Random(3)
    for _ in range(300):
        n = rand.randint(1, 7)
        ends = [(rand.randint(0, 9), rand.randint(0, 9)) for _ in range(n)]
        edges = [(i, j, rand.randint(0, 5)) for i in range(n) for j in range(i + 1, n) if rand.random() < 0.5]
        cost = lambda lab: sum(b if x else a for x, (a, b) in zip(lab, ends)) + sum(w for i, j, w in edges if lab[i] != lab[j])  # noqa: E731, B023
        assert cost(html_extract.minimum_cut(ends, edges)) == min(map(cost, product((False, True), repeat=n)))


def test_extract_equals_the_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        plain = [" ".join(unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in parts]
        assert got[r.page_id].text == "\n\n".join(filter(None, plain)) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_odd_pages(spark):
    rows = [(1, None, None, 1), (2, "u", "", 1), (2, "u", "", 1), (None, "u", PAGE, None), (3, "u", "<p>" + "word " * 200_000, 1), (4, "u", "<div>" * 3000 + "deep", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_extract.extract(df).collect()
    assert len(got) == 6 and [r.n_chars for r in got if r.page_id in (1, 2)] == [0, 0, 0]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_media_round_trip(spark, odd_docs, no_docs):
    rows = media.media_columns(odd_docs, new_path(spark, "media")).collect()
    want = Counter()
    for r in odd_docs.collect():
        data = (r.text or "").encode()
        payload = data + b"\xff" * (576 if not data else -len(data) % 576)
        want[r.doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by_text.values())
    assert media.media_columns(no_docs, new_path(spark, "media")).count() == 0


def test_archives_are_read_by_ranges_and_members_again_alone(spark, docs, monkeypatch):
    folder = new_path(spark, "media")
    media.store(docs, folder)
    for step in (1000, 50_000, 1 << 30):
        reader = media.MediaReader(folder, step)
        ids = [i for part in reader.partitions() for b in reader.read(part) for i in b.column(0).to_pylist()]
        assert sorted(ids) == sorted(r.doc_id for r in docs.select("doc_id").collect())

    class Flaky:
        """Every first read of a member fails or is short."""

        def __init__(self, files):
            self.files, self.seen = files, Counter()

        def open_input_file(self, path):
            source, outer = self.files.open_input_file(path), self

            class One:
                def __enter__(self):
                    return self

                def __exit__(self, *a):
                    source.close()

                def read_at(self, n, at):
                    outer.seen[at] += 1
                    if outer.seen[at] == 1:
                        if at % 1024:
                            raise OSError("lost")
                        return source.read_at(n, at)[:-1]
                    return source.read_at(n, at)

            return One()

    files, base = media._opened(folder)
    name = reader.partitions()[0].pieces[0][0]
    import pyarrow as pa

    with files.open_input_file(f"{base}/{name}.index") as source:
        index = pa.ipc.open_file(source).read_all().to_pylist()
    whole = media.MediaReader.members(Flaky(files), f"{base}/{name}.tar", *([m[c] for m in index[:9]] for c in ("offset", "size", "crc")))
    assert [zlib.crc32(m) for m in whole] == [m["crc"] for m in index[:9]]
    flaky = Flaky(files)
    monkeypatch.setattr(media.time, "sleep", lambda _: None)
    for m in index[:5]:
        data = media.MediaReader.member(flaky, f"{base}/{name}.tar", m["offset"], m["size"], m["crc"])
        assert zlib.crc32(data) == m["crc"]
    assert all(n == 2 for n in flaky.seen.values())
    with pytest.raises(OSError):
        media.MediaReader.member(files, f"{base}/{name}.tar", index[0]["offset"], index[0]["size"], index[0]["crc"] ^ 1)


def test_a_range_is_one_request_and_one_part_of_the_index(spark, docs, monkeypatch):
    monkeypatch.setattr(media, "RANGE_BYTES", 40_000)
    folder = new_path(spark, "media")
    files, base = media._opened(folder)
    archive = media._Archive(folder if files.create_dir(base) is None else folder)
    for k in range(300):
        archive.add(k, bytes([k % 251]) * 700)
    import pyarrow as pa

    name, cuts = archive.close(pa.int64())
    assert len(cuts) > 6 and cuts[0] == 0 and cuts == sorted(cuts)
    reader, seen, opens = media.MediaReader(folder, 1 << 20), [], Counter()
    monkeypatch.setattr(media, "_opened", lambda _: (Counting(files, opens), base))
    for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
        seen += [i for b in reader.read(media.ByteRange([(name, k, k + 1, low, high)])) for i in b.column(0).to_pylist()]
    assert seen == list(range(300)) and opens[f"{base}/{name}.tar"] == len(cuts) - 1


def test_ranges_grow_with_the_whole(spark, monkeypatch):
    monkeypatch.setattr(media, "RANGE_BYTES", 4_000)
    monkeypatch.setattr(media, "MOST_RANGES", 7)
    folder = new_path(spark, "media")
    files = media._opened(folder)[0]
    files.create_dir(media._opened(folder)[1])
    made, n = [], 0
    import pyarrow as pa

    for size in (5, 40, 1, 25):  # archives of different length, parts of index smaller than a range
        archive = media._Archive(folder)
        for _ in range(size):
            archive.add(n, bytes([n % 251]) * 1500)
            n += 1
        made.append(archive.close(pa.int64()))
    import pyarrow.parquet as pq

    files.create_dir(f"{media._opened(folder)[1]}/manifest")
    pq.write_table(pa.table({"name": [m[0] for m in made], "cuts": [m[1] for m in made]}), f"{media._opened(folder)[1]}/manifest/a.parquet")
    reader = media.MediaReader(folder, 4_000)
    parts = reader.partitions()
    assert len(parts) <= 8 and sorted(i for p in parts for b in reader.read(p) for i in b.column(0).to_pylist()) == list(range(n))


def test_a_task_that_fails_leaves_no_archive(spark):
    folder = new_path(spark, "media")
    files, base = media._opened(folder)
    files.create_dir(base)
    archive = media._Archive(folder)
    archive.add(1, b"x")
    archive.drop()
    from pyarrow import fs

    assert files.get_file_info(fs.FileSelector(base)) == []


class Counting:
    def __init__(self, files, opens):
        self.files, self.opens = files, opens

    def open_input_file(self, path):
        self.opens[path] += 1
        return self.files.open_input_file(path)


def test_damaged_image_is_an_error():
    good = media.to_png(media.padded(b"text"))
    assert media.from_png(good) == media.padded(b"text")
    with pytest.raises(ValueError):
        media.from_png(good[:40] + bytes([good[40] ^ 1]) + good[41:])


def plain_best_fit(sizes, masks, capacity):
    bins, out = [], []
    for s, m in zip(sizes, masks):
        fitting = [(r, i) for i, (r, c) in enumerate(bins) if r >= s and not c & m]
        if fitting:
            r, i = min(fitting)
            bins[i] = (r - s, bins[i][1] | m)
        else:
            i = len(bins)
            bins.append((capacity - s, m))
        out.append(i)
    return out


def test_best_fit_equals_looking_at_every_bin():
    rand = random.Random(4)
    for _ in range(200):
        n = rand.randint(0, 60)
        sizes = sorted((rand.randint(0, 30) for _ in range(n)), reverse=True)
        masks = [1 << rand.randint(0, 5) | (1 << rand.randint(6, 9) if rand.random() < 0.4 else 0) for _ in range(n)]
        assert packing.best_fit(sizes, masks, 30) == plain_best_fit(sizes, masks, 30)


def check_packing(df, rows, capacity):
    import pandas as pd

    docs = df.select("doc_id", "text", "source").toPandas()
    docs["n"] = docs["text"].map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    got = pd.DataFrame([r.asDict() for r in rows])
    assert Counter(got.groupby("doc_id", dropna=False)["size"].sum().to_dict().values()) == Counter(docs.groupby("doc_id", dropna=False)["n"].sum().to_dict().values())
    assert got.groupby(["shard", "bin"])["size"].sum().max() <= capacity
    return got, docs


def test_packing_of_documents(docs, spark):
    rows = packing.pack(docs, capacity=300, shard_items=64).collect()
    got, d = check_packing(docs, rows, 300)
    both = got.merge(d, on="doc_id")
    for _, b in both[both["bin"] >= 0].groupby(["shard", "bin"]):
        assert b["source"].is_unique and b["text"].is_unique
    again = packing.pack(docs.repartition(7), capacity=300, shard_items=64)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_packing_of_odd_rows(odd_docs, no_docs, spark):
    rows = packing.pack(odd_docs, capacity=100).collect()
    check_packing(odd_docs, rows, 100)
    assert Counter(r.doc_id for r in rows if r.piece == 0 or r.size < 100)[10] == 2
    assert packing.pack(no_docs).count() == 0
    hot = spark.createDataFrame([(1, "same words", "a")] * 700 + [(i, f"t {i}", "b") for i in range(100)], "doc_id long, text string, source string")
    rows = packing.pack(hot, capacity=50, shard_items=100).collect()
    assert len(rows) == 800 and max(Counter(r.shard for r in rows).values()) < 250
    assert len({(r.shard, r.bin) for r in rows if r.doc_id == 1}) == 700


def test_shards_depend_on_rows_alone(spark):
    """More copies of one row move no other row, and neither does a new partitioning."""
    other = [(1000 + i, f"t {i}", "b") for i in range(390)]
    make = lambda n: spark.createDataFrame([(1, "same words", "a")] * n + other, "doc_id long, text string, source string")
    shards = lambda df: {r.doc_id: r.shard for r in packing.pack(df, capacity=50, shard_items=1 << 20).collect()}
    assert shards(make(250)) == shards(make(300).repartition(7))
    rows = [sorted(map(tuple, packing.pack(df, capacity=50, shard_items=100).collect())) for df in (make(300), make(300).repartition(7))]
    assert rows[0] == rows[1]


def test_copies_are_made_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 7)
    df = spark.createDataFrame([(1, "same words", "a")] * 50 + [(2, "two", "b")], "doc_id long, text string, source string")
    assert Counter(r.doc_id for r in packing.pack(df, capacity=50).collect()) == {1: 50, 2: 1}


def test_full_pieces_of_repeated_rows_have_bins_of_their_own(spark):
    long_text = " ".join(f"w{i}" for i in range(250))
    large = 2**60 + 1
    rows = [(large, long_text, "a")] * 3 + [(None, long_text, "a")] * 2 + [(2, "short", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(df, capacity=100).collect()
    check_packing(df, got, 100)
    full = [r for r in got if r.bin < 0]
    assert len(full) == 10 and len({(r.shard, r.bin) for r in full}) == 10
    assert Counter((r.doc_id, r.piece) for r in full) == {(large, 0): 3, (large, 1): 3, (None, 0): 2, (None, 1): 2}
