"""The training-data operators against brute force, and on nulls, empties, repeats and clashing columns."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlake.llm import ann, html, linededup, mixing, packing, pseudonyms, queries, rules, simhash, toxicity, warc
from strandlake.tables import shared_dir

LONG = "word%d " * 30_000 % tuple(range(30_000))
ODD = [(1, "Alpha beta gamma delta"), (2, None), (3, ""), (None, "Alpha beta gamma delta"), (5, LONG), (1, "Alpha beta gamma delta"), (7, " \t\n "), (8, "é ß 数 word")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a long text, repeated ids and rows, and extra columns with our names."""
    rows = [(i, t, "x", 1, None) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n int, fp long").cache()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def union_find(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


# ------------------------------------------------------------------ 4


def slow_fingerprint(text):
    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("limit", [1024, 3])
def test_simhash(docs, limit):
    got = simhash.simhash_components(docs, shard_limit=limit).toPandas().sort_values("id")
    texts = docs.toPandas().sort_values("doc_id")
    fps = [slow_fingerprint(t) for t in texts.text]
    assert [x & (1 << 64) - 1 for x in got.fp] == fps
    roots = union_find(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert list(got.component_id) == [texts.doc_id.iloc[r] for r in roots]


def test_simhash_of_odd_rows(odd, spark):
    got = [(r["id"], r["component_id"]) for r in simhash.simhash_components(odd).collect()]
    assert len(got) == len(ODD) and (2, 2) in got and (3, 2) in got and (7, 2) in got and (None, 1) in got
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5, 8]
    assert simhash.simhash_components(odd.where("false")).count() == 0


def test_near_copies_under_null_and_repeated_ids(spark):
    texts = [" ".join(f"{w}{k}" for k in range(30)) for w in ("red", "blue", "green", "grey", "black")]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (4, texts[2]), (4, texts[3]), (4, texts[3]), (None, texts[3]), (9, texts[4]), (None, texts[4])]
    kept = [(r["doc_id"], r["text"]) for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=lambda r: texts.index(r[1])) == list(zip((None, None, 4, 4, 9), texts))


def test_bk_tree_links_connect_like_all_pairs():
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 63, 20)]
    values = sorted({v ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for v in base for _ in range(20)})
    links = [(values.index(a), values.index(b)) for a, b in simhash.shard_links(values, 3)]
    assert len(links) < len(values)
    assert union_find(len(values), links) == union_find(len(values), [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 3])


# ------------------------------------------------------------------ 6


def test_line_dedup(docs):
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    lines = sorted((i, no, x) for i, t in docs.select("doc_id", "text").collect() for no, x in enumerate(t.split("\n")) if len(x) >= linededup.LEAST_CHARS)
    first = {}
    for i, no, x in lines:
        first.setdefault(x, (i, no))
    texts = list(first)
    sets = [linededup.shingles(x) for x in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if (n := len(sets[a] & sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    roots = union_find(len(texts), links)
    keep = {}
    for k, r in enumerate(roots):
        keep[r] = min(keep.get(r, first[texts[k]]), first[texts[k]])
    number = {x: k for k, x in enumerate(texts)}
    gone = {(i, no) for i, no, x in lines if (i, no) != keep[roots[number[x]]]}
    for i, t in docs.select("doc_id", "text").collect():
        assert got[i] == "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone)


def test_line_dedup_of_odd_rows(odd, spark):
    line = "A line that is long enough to count here."
    near = line.replace("here", "hers")
    more = spark.createDataFrame([(10, f"{line}\nshort\nshort", "a", 0, None), (11, f"x\n{line}\n{near}", "b", 0, None)], odd.schema)
    out = linededup.dedup_lines(odd.unionByName(more))
    got = {(r["doc_id"], r["id"]): (r["text"], r["n_dropped"]) for r in out.collect()}
    assert got[10, "a"] == (f"{line}\nshort\nshort", 0) and got[11, "b"] == ("x", 2) and got[2, "x"] == (None, 0) and got[3, "x"] == ("", 0)
    assert out.count() == len(ODD) + 2
    assert linededup.dedup_lines(odd.where("false")).count() == 0


def test_line_dedup_under_null_and_repeated_ids(spark):
    one, two, three, four = (f"{w} is a line that is long enough to count." for w in ("First", "Another one, the second,", "What comes as the third", "Last of all, and fourth,"))
    rows = [(1, "a", one), (None, "b", f"{one}\n{two}"), (None, "c", f"{three}\n{one}"), (5, "d", f"{one}\n{four}"), (5, "e", "Only here, and in no other document, is it.\nx"), (None, "f", "Stays too, as nothing of the kind recurs.")]
    copies = [(7, "g", "Word for word the same text in both rows."), (None, "h", "Thrice the same under no id, word for word.")]
    out = linededup.dedup_lines(spark.createDataFrame(rows + copies * 2, "doc_id long, name string, text string"))
    got = [(r["name"], r["text"]) for r in out.collect()]
    want = [("a", one), ("b", two), ("c", three), ("d", four), ("e", rows[4][2]), ("f", rows[5][2])]
    assert sorted(got) == sorted(want + [x for _, n, t in copies for x in ((n, t), (n, ""))])


def test_short_lines_recur_too(spark):
    rows = [(1, "All rights reserved.\nOne"), (2, "Two\nAll rights reserved."), (3, "Sources\nMore"), (4, "Sources"), (5, "Sourced")]
    got = sorted((r["doc_id"], r["text"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [rows[0], (2, "Two"), rows[2], (4, ""), rows[4]]


def test_short_lines_go_if_asked(spark):
    rows = [(1, "Of.\n- \nyes\n\nno"), (2, "Of.\n\nThe.\nyes\nThe."), (3, "No")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in linededup.dedup_lines(df).collect()) == rows
    got = sorted((r["doc_id"], r["text"], r["n_dropped"]) for r in linededup.dedup_lines(df, short_lines=True).collect())
    assert got == [(1, rows[0][1], 0), (2, "\nThe.", 3), (3, "No", 0)]


def test_line_dedup_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "The same line, word for word.", 8, 9, 5, 6), (2, "The same line, word for word.", 8, 9, 5, 6)], "doc_id long, text string, n_lines int, Row int, n_dropped int, drop int")
    out = linededup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "Row", "drop", "n_lines", "n_dropped"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, df.first()["text"], 9, 6, 1, 0), (2, "", 9, 6, 1, 1)]
    only = linededup.without_repeated_lines(df)
    assert only.columns == df.columns and sorted(tuple(r) for r in only.collect())[1] == (2, "", 8, 9, 5, 6)


def test_large_bands_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", 40)
    monkeypatch.setattr(linededup, "PART", 16)
    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefghijklmnopqrst"))
    base = rng.choice(letters, 300)
    lines = []
    for f in range(60):  # families of two, all of them about 0.6 alike and so in each other's bands
        own = base.copy()
        own[rng.integers(0, 300, 12)] = rng.choice(letters, 12)
        near = own.copy()
        near[rng.integers(0, 300, 2)] = "z"
        lines += ["".join(own), "".join(near)]
    # members of one band, as a table of places would give them
    schema = "row long, id long, text string"
    docs = spark.createDataFrame([(k, k, x) for k, x in enumerate(lines)], schema)
    table = linededup.line_table(docs)
    one = table.withColumn("bands", F.array(F.lit(5).cast("long")))
    roots = {r["node"]: r["root"] for r in linededup.line_components(docs, one).collect()}
    h = [linededup.line_hash(x.encode()) for x in lines]
    want = union_find(len(lines), [(a, b) for a in range(len(lines)) for b in range(a) if linededup.jaccard(lines[a], lines[b]) >= 0.8])
    got = [roots.get(x, x) for x in h]
    first = {}
    assert [first.setdefault(r, k) for k, r in enumerate(got)] == want and len(set(want)) > 20


def test_banding_recall():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    found = tried = 0
    for _ in range(300):
        a = list(rng.choice(words, 40))
        b = list(a)
        b[int(rng.integers(40))] = str(rng.choice(words))
        x, y = " ".join(a), " ".join(b)
        if linededup.jaccard(x, y) >= 0.8:
            k = linededup.signatures([x, y])
            tried, found = tried + 1, found + bool((k[0] == k[1]).any())
    assert tried > 100 and found / tried >= 0.98


# ------------------------------------------------------------------ 9


def test_packing(docs):
    from tokenizers import Tokenizer

    got = packing.pack(docs).toPandas()
    coder = Tokenizer.from_file(packing.default_tokenizer())
    for i, t in docs.select("doc_id", "text").collect():
        ids = np.array([*coder.encode(t, add_special_tokens=False).ids, 0], "<u4")
        mine = got[got.doc_id == i].sort_values("piece")
        assert list(mine.start) == list(range(0, len(ids), 2048)) and mine.length.sum() == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(mine.start, mine.length, mine.ids_crc32))
    check_packed(got, 2048)
    assert got.sequence_id.nunique() <= 1.01 * np.ceil(got.length.sum() / 2048) + 1


def check_packed(got, capacity):
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= capacity


def test_packing_of_odd_rows(odd):
    got = packing.pack(odd, capacity=16).toPandas()
    check_packed(got, 16)
    assert (got[got.doc_id == 2].length == 1).all() and len(got[got.doc_id == 1]) == 2
    assert packing.pack(odd.where("false")).count() == 0


def test_word_ids_are_the_tokenizers():
    coder = packing.tokenizer_at(packing.default_tokenizer())
    for t in ("It's Straße ÉTÉ naïve! x2³ a<|endoftext|>b", "don't 'S I'LL 12,5 _a_b __", "日本 ｆｕｌｌ İİ ǅ  x y", "á ë ª º µ", "tab\there\x0bnow", " "):
        want = np.array([*coder.tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert coder.encode(t.encode()) == want, t


def fewest(lengths, capacity):
    """The exact number of sequences, by search."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= lengths[k]}):
            at = rooms.index(room)
            place(k + 1, [*rooms[:at], room - lengths[k], *rooms[at + 1 :]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


def test_dominance_keeps_an_optimum():
    rng = np.random.default_rng(5)
    for _ in range(150):
        lengths = [int(x) for x in rng.integers(2, 20, rng.integers(3, 10))]
        rest = collections.Counter(lengths)
        fixed = packing.reduce_by_dominance(rest, 20)
        left = [x for x, n in rest.items() for _ in range(n)]
        assert sorted(left + [x for g, n in fixed for x in g * n]) == sorted(lengths)
        assert sum(n for _, n in fixed) + (fewest(left, 20) if left else 0) == fewest(lengths, 20)


# ------------------------------------------------------------------ 10


def slow_rules(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = (text or "").split("\n")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = collections.Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    has_word = lambda x: re.search("[^\x20\x09-\x0d]", x)
    dup = [x for k, x in enumerate(lines) if has_word(x) and x in lines[:k]]
    out = [len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(dup), len(inside), sum(len(w) for x in dup for w in re.findall("[^\x20\x09-\x0d]+", x))]
    for n in rules.NGRAM_SHARES:
        seen, cover = set(), set()
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            if g in seen:
                cover |= set(range(i, i + n))
            seen.add(g)
        out.append(sum(len(words[i]) for i in cover))
    return out


def test_quality_rules(docs):
    texts = [t for _, t in docs.select("doc_id", "text").collect()] + ["a b c d e f g h i j k " * 9, "x\nx\n\n x", "数 é数\n数 é数"]
    for t in texts:
        assert rules.measure(t.encode()) == slow_rules(t)
    found = rules.quality_rules(docs)
    assert found.where("base_failed and kept").count() == 0
    kept = {r["id"] for r in found.where("kept").collect()}
    assert {r["doc_id"] for r in rules.keep_good(docs).collect()} == kept


def test_quality_rules_of_odd_rows(odd):
    got = rules.quality_rules(odd).collect()
    assert len(got) == len(ODD) and all(r["n_words"] == 0 and r["base_failed"] for r in got if r["id"] in (2, 3, 7))
    assert rules.keep_good(odd).columns == odd.columns and rules.keep_good(odd).count() == 1


# ------------------------------------------------------------------ 3


def test_warc_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    extra = [(90001, "http://a/ b\n?", None), (90002, "", ""), (90003, None, "WARC/1.1\r\n\r\n\r\nContent-Length: 3"), (90003, None, "WARC/1.1\r\n\r\n\r\nContent-Length: 3"), (None, "http://n", "é\r\n\r\n")]
    every = pages.unionByName(spark.createDataFrame(extra, pages.schema))
    found = warc.round_trip(every).cache()
    rows = warc.page_records(found).toPandas()
    want = every.toPandas()
    assert len(rows) == len(want)
    body = {}
    for r in found.collect():
        if r["response"]["record_type"] == "response":
            body.setdefault(r["metadata"]["fields"]["page-id"], bytes(r["response"]["payload"]))
            assert r["request"]["http_status"].startswith("GET ")
    first = {}
    for i, h in zip(want.page_id, want.html):
        h = h or ""
        i = None if pd.isna(i) else int(i)
        first[h] = i if first.get(h) is None else min(first[h], i if i is not None else first[h])
    for r in rows.itertuples():
        if pd.isna(r.page_id):
            continue
        h = next(x or "" for i, x in zip(want.page_id, want.html) if i == r.page_id)
        assert r.payload_bytes == len(h.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        if r.record_type == "response":
            assert r.page_id == first[h] and pd.isna(r.refers_to) and body[str(int(r.page_id))] == h.encode()
        else:
            assert r.refers_to == first[h]


def test_warc_transactions_over_batches(spark, sf):
    """Records that come together and those that do not give the same captures, payloads included."""
    pages = queries.table(spark, sf, "pages")
    path = warc.new_path(spark, "warc")
    warc.write_archives(pages, path)
    records = warc.read_archives(spark, path).where("not (record_type = 'request' and target_uri like '%1%')").repartition(7)
    known = lambda df: sorted(map(repr, df.selectExpr("capture_id", "response", "request is null as r", "metadata.fields['page-id'] as page").collect()))
    expected = known(warc.assemble(records))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        assert known(warc.assemble(records, unique_ids=True)) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert known(warc.assemble(records.coalesce(1), unique_ids=True)) == expected and len(expected) == pages.count()


def test_warc_threshold_and_empty(spark):
    schema = "page_id long, url string, html string, digest string"
    pages = spark.createDataFrame([(2, "u", "abc", "x"), (1, "u", "abc", "x"), (4, "u", "abcdef", "x"), (3, "u", "abcdef", "x")], schema)
    got = {r["page_id"]: r["record_type"] for r in warc.page_records(warc.round_trip(pages, dedup_from=4)).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


# ------------------------------------------------------------------ 5


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav>
    <article><h1>Head &amp; line</h1><p>One <b>two
    three</b><br>four<p>Five &#233;&nbsp;x &copy<div class="ad banner">Buy</div><table><tr><td>a<td>b</table><aside>Side</aside>
    <form><p>Mail</form><script>var x = "</p><p>no";</script><section id="comments"><p>First!</section></article>
    <div class="cookie-notice">Cookies</div><footer>End</footer></body></html>"""
    assert html.main_text(page) == "Head & line\n\nOne two three four\n\nFive é x ©\n\na\n\nb"
    assert html.main_text("") == "" and html.main_text("just text") == "just text"
    assert html.main_text("<p>a<!-- <p>b --><p hidden>c<p>d") == "a\n\nd"
    assert html.main_text("<div>" * 5000 + "deep") == "deep"


def test_class_words_empty_no_article():
    assert html.main_text('<body><div class="layout with-sidebar"><h1>T</h1><p>Story text</p></div></body>') == "T\n\nStory text"
    assert html.main_text('<p class="share-price">Up</p><div class="notice-board-history">Old</div><div class="entry-header"><h1>Title</h1></div>') == "Up\n\nOld\n\nTitle"
    assert html.main_text('<div class="sidebar-wrapper"><p>All of the page</p><footer>End</footer></div>') == "All of the page"
    off = ("cookie-notice", "site-footer", "comments", "related-posts", "ad", "newsletter_signup", "social-share", "main-nav", "comment-list")
    assert html.main_text("<p>Text</p>" + "".join(f'<div class="{c}">No</div>' for c in off)) == "Text"


def test_hostile_pages_take_linear_time():
    import time

    began = time.time()
    n = 60_000
    for page in ("<a " * n, '<a b="' * n + ">", "<div>" * n + "</b>" * n, "<p>" * n, "<!--" * n, "<![CDATA[" * n, "<b><article>" + "<div>" * n + "</b>" * n, "<script>" * n, "<ul><li>" * n, "&" * n, "<a class='" * n + ">x"):
        html.candidates(root := html.parse(page))
        html.blocks_of(root, {})
    assert time.time() - began < 30
    assert html.main_text("1 <a 2") == "1 <a 2" and html.main_text('<p title="x>1</p><p>2</p>') == "1\n\n2"


def test_main_texts_against_a_plain_count(spark, sf):
    """The templates counted page by page in plain dictionaries, on all pages and on a site with boxes."""
    made = [(10_000 + k, f"http://box.org/{k}", f"<main><article><p>Own {k} text</p><div><p>Join our list</p></div><p>More {k}</p></article></main><div>Part {k % 3}</div>", "x") for k in range(9)]
    odd = [(20_001, None, None, "x"), (20_002, "http://box.org/", "", "x"), (None, "http://box.org/1", made[1][2], "x"), (10_001, "http://box.org/1", made[1][2], "x")]
    given = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html", F.lit("y").alias("host"))
    pages = given.unionByName(spark.createDataFrame(made + odd, given.schema))
    rows = pages.collect()
    places, surroundings, on = {}, {}, collections.Counter()
    trees = {}
    for r in rows:
        host = (re.match("[a-z]+://([^/]*)", r["url"] or "") or [None, ""])[1]
        page = r["html"] or ""
        found = trees[host, page] = html.candidates(html.parse(page))
        for t, article, beside in found.values():
            places.setdefault((host, t, article is None, page if article is None else article), set()).add(beside)
    for (host, t, free, _), beside in places.items():
        surroundings.setdefault((host, t, free), []).append(None if free else min(beside))
    for (host, t, free), sides in surroundings.items():
        on[host, t] += len(sides) if free else len(set(sides)) * (len(set(sides)) >= html.UNLIKE * len(sides))
    want = []
    for r in rows:
        host = (re.match("[a-z]+://([^/]*)", r["url"] or "") or [None, ""])[1]
        gone = frozenset(t for (h, t), n in on.items() if h == host and n >= html.LEAST_PAGES)
        want.append((str(r["page_id"]), html.main_text(r["html"] or "", gone)))
    out = html.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = [(str(r["page_id"]), r["text"]) for r in out.collect()]
    assert sorted(got) == sorted(want)
    assert ("10004", "Own 4 text\n\nMore 4") in got and ("20001", "") in got
    assert html.extract(pages.where("false")).count() == 0


def test_templates_go_and_paragraphs_stay(spark):
    body = lambda k: f"<div><p>Welcome to our site</p></div><div><p>Story {k} is told</p></div>"
    rows = [(k, f"http://a.org/{k}", body(k), "t") for k in range(20)] + [(100 + k, "http://a.org/same", body(3), "t") for k in range(30)]
    rows += [(200, "http://b.org/", body(0), "t"), (201, None, None, "t"), (202, "x", "", "t"), (200, "http://b.org/", body(0), "t")]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()]
    assert len(got) == len(rows)
    assert (7, "Story 7 is told", 15) in got and (110, "Story 3 is told", 15) in got
    assert got.count((200, "Welcome to our site\n\nStory 0 is told", 36)) == 2 and (201, "", 0) in got


def test_templates_inside_articles_go(spark):
    words = lambda k: [f"<p>Paragraph {j} of story {k} is here</p>" for j in range(8)]
    page = lambda top, parts: f"<body><div><p>Top {top}</p></div><main><article>{''.join(parts)}</article></main></body>"
    box = "<div><p>Write to us</p><p>We answer soon</p></div>"
    rows = [(k, "http://a.org/", page(k, words(k)[:4] + [box] + words(k)[4:])) for k in range(12)]
    # one article under changing heads, and edited copies of one article: their paragraphs are no templates
    rows += [(100 + k, "http://a.org/", page(k, words(50))) for k in range(20)]
    copy = lambda k: [x if j != k % 8 else f"<p>Edit {k}</p>" for j, x in enumerate(words(60))]
    rows += [(200 + k, "http://a.org/", page(k, copy(k))) for k in range(40)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = lambda parts: "\n\n".join(x[3:-4] for x in parts)
    assert all(got[k] == text(words(k)) for k in range(12))
    assert all(got[100 + k] == text(words(50)) for k in range(20)) and all(got[200 + k] == text(copy(k)) for k in range(40))


def test_templates_of_a_part_of_a_large_host_go(spark):
    rows = [(k, "http://a.org/", f"<div><p>In this section</p></div><p>Story {k}</p>" if k < 6 else f"<p>Story {k}</p>") for k in range(400)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Story {k}" for k in range(400))


# ------------------------------------------------------------------ 8


def test_ann(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    bad = [(100_001, None, 0), (100_020, [0.0] * 64, 0), (100_040, [float("nan")] * 64, 0), (100_060, [1.0, None], 0), (None, [1.0] * 64, 0)]
    every = vectors.unionByName(spark.createDataFrame(bad, vectors.schema))
    got = ann.search(every, lambda i: i % 20 == 0, 20).toPandas()
    t = vectors.toPandas().sort_values("vec_id")
    x, ids = np.stack(t.embedding).astype(float), t.vec_id.to_numpy()
    hit = 0
    wanted = [k for k, i in enumerate(ids) if i % 20 == 0]
    for k in wanted:
        score = (x * x[k]).sum(1)
        score[k] = -np.inf
        top = np.lexsort((ids, -score))[:20]
        mine = got[got.query_id == ids[k]].sort_values("rank")
        hit += len(set(ids[top]) & set(mine.vec_id))
        assert np.allclose(mine.score, [score[np.searchsorted(ids, v)] for v in mine.vec_id], rtol=0, atol=1e-12)
        assert list(mine["rank"]) == list(range(1, len(mine) + 1))
    assert set(got.query_id) == {ids[k] for k in wanted} and hit / (20 * len(wanted)) >= 0.9
    assert ann.search(every.where("false"), lambda i: i % 20 == 0).count() == 0


def recall_of(got, ids, x, k=20):
    hit = n = 0
    for i in got.query_id.unique():
        score = x @ x[np.searchsorted(ids, i)]
        score[np.searchsorted(ids, i)] = -np.inf
        top = np.lexsort((ids, -score))[:k]
        hit, n = hit + len(set(ids[top]) & set(got[got.query_id == i].vec_id)), n + len(top)
    return hit / n


def test_ann_recall_at_a_larger_size(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.search(vectors, lambda i: i % 20 == 0, 20).toPandas()
    t = vectors.toPandas().sort_values("vec_id")
    assert recall_of(got, t.vec_id.to_numpy(), np.stack(t.embedding).astype(float)) >= 0.93


@pytest.mark.parametrize("size", [1e8, 1e160, 1e200])
def test_ann_with_a_few_large_vectors(spark, size):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 16))
    x[[7, 40, 300]] *= size
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, list int")
    got = ann.search(df, lambda i: i % 20 == 0, 10, lists=20).toPandas()
    assert len(got) == 300 and recall_of(got, np.arange(600), x, 10) >= 0.9
    large = got[got.query_id == 20].vec_id.tolist()
    assert {k for k in (7, 40, 300) if x[k] @ x[20] > 0} <= set(large)


def test_few_probes_where_vectors_lie_in_groups(spark):
    rng = np.random.default_rng(9)
    centres = 10 * rng.standard_normal((40, 12))
    x = centres[rng.integers(0, 40, 1500)] + rng.standard_normal((1500, 12))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = ann.Index(x, float(ann.norms(x).max()) * 1.001, 40)
    listed = spark.createDataFrame([(k, v.tolist(), int(m)) for k, (v, m) in enumerate(zip(x, index.lists_of(x)))], "id long, v array<double>, list int")
    assert ann.enough_probes(listed, [(k, x[k].tolist()) for k in range(0, 1500, 30)], index, 10) < 15
    got = ann.search(df, lambda i: i % 20 == 0, 10).toPandas()
    assert recall_of(got, np.arange(1500), x, 10) >= 0.9


def test_ann_ties_and_few(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(40, [0.0, 1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i == 5, 4).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 1.0)]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert ann.search(few, lambda i: i % 20 == 0, 20).count() == 2


# ------------------------------------------------------------------ 2


def test_pseudonyms(spark):
    text = "Mail jo.do@x.org or +1 (212) 555-0142, 2020-02-29, 70.1.2.3, 4111 1111 1111 1111, 123-45-6789, 4111111111111112, v2.0.1"
    rows = [(1, text, 0), (2, None, 0), (3, "", 0), (4, "on 2020-02-29 again " + LONG, 0), (4, "on 2020-02-29 again", 0)]
    got = [r for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, found int")).collect()]
    out = got[0]["text"]
    assert got[1]["text"] is None and got[2]["text"] == "" and len(got) == 5
    for secret in ("jo.do@x.org", "(212) 555-0142", "2020-02-29", "70.1.2.3", "4111 1111 1111 1111", "123-45-6789"):
        assert secret not in out
    assert "4111111111111112, v2.0.1" in out
    date = re.search(r"\d{4}-02-29", out)[0]
    assert f"on {date} again" in got[4]["text"] and f"on {date} again" in got[3]["text"]
    card = re.search(r"4\d{3} \d{4} \d{4} \d{4}", out)[0].replace(" ", "")
    assert sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(card))) % 10 == 0
    assert re.search(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", out)


def test_pseudonyms_of_more_forms(spark):
    text = "born 31/12/1984 and 29/02/2012, card 3782 822463 10005, to DE89 3704 0044 0532 0130 00 or GB29NWBK60161331926819, not DE88 3704 0044 0532 0130 00"
    out = pseudonyms.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    got = out["text"]
    assert out["n_found"] == 6 and out["n_changed"] == 5 and got.endswith("not DE88 3704 0044 0532 0130 00")
    day, month, _ = re.search(r"born (\d\d)/(\d\d)/(\d{4})", got).groups()
    assert int(day) > 12 and 1 <= int(month) <= 12 and re.search(r"and 29/02/(\d{4})", got) and "29/02/2012" not in got
    card = re.search(r"card (\d{4} \d{6} \d{5})", got)[1].replace(" ", "")
    assert sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(card))) % 10 == 0
    for found in (re.search(r"to (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d)", got)[1], re.search(r"or (GB\d\dNWBK\d{14})", got)[1]):
        x = found.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    assert "0440532" not in got and "60161331926819" not in got


def test_dates_are_permuted_within_their_form(spark):
    leap = spark.createDataFrame([(f"29/02/{y}",) for y in range(1904, 2097, 4)] + [(f"{y}-02-29",) for y in range(1904, 2097, 4)], "t string")
    out = [r["p"] for r in leap.select(pseudonyms.pseudonym(F.col("t"), "k").alias("p")).collect()]
    assert len(set(out)) == 98 and all("29/02" in x for x in out[:49]) and all("-02-29" in x for x in out[49:])
    moved = {(int(x[:4]) - y) % 196 for x, y in zip(out[49:], range(1904, 2097, 4))}
    assert len(moved) > 10  # no fixed shift
    late = spark.sql("SELECT explode(sequence(date'2023-01-01', date'2023-12-31')) AS d").where("day(d) > 12").select(F.date_format("d", "dd/MM/yyyy").alias("t"))
    out = [r["p"] for r in late.select(pseudonyms.pseudonym(F.col("t"), "k").alias("p")).collect()]
    assert len(set(out)) == 221 and all(int(x[:2]) > 12 and pd.Timestamp(int(x[6:]), int(x[3:5]), int(x[:2])) for x in out)


def test_long_and_hostile_texts_are_read(spark):
    rows = [("a@" + "a." * 500_000,), ("1-1-1-" * 200_000,), ("+1 1 1 " * 150_000,), ("password=" * 100_000,), ("1.1.1." * 150_000,), ("AB12 " * 200_000,), ("x@b" + ".b" * 300_000 + " jo@do.org",), ("4111 " * 200_000,), ("(212) " * 150_000,), ("key:'" * 150_000,)]
    got = pseudonyms.pseudonymise(spark.createDataFrame([(k, t) for k, (t,) in enumerate(rows)], "doc_id long, text string")).select("doc_id", F.right("text", F.lit(30)).alias("t")).collect()
    assert len(got) == len(rows) and not any("jo@do.org" in r["t"] for r in got)
    assert pseudonyms.pseudonymise(spark.createDataFrame([], "doc_id long, text string, found int")).count() == 0


def test_the_key_decides(spark):
    df = spark.createDataFrame([(1, "jo@do.org 4111 1111 1111 1111", 1, 2)], "doc_id long, text string, found int, new int")
    one, two, again = (pseudonyms.pseudonymise(df, key=k).first()["text"] for k in ("a", "b", "a"))
    assert one == again != two


def test_feistel_is_a_permutation(spark):
    rows = spark.range(24).select(F.col("id").alias("x"))
    s = pseudonyms.feistel(F.floor(F.col("x") / 6), F.col("x") % 6, F.lit(4), F.lit(6), "k", F.lit("t"))
    assert len({(r["s"]["a"], r["s"]["b"]) for r in rows.select(s.alias("s")).collect()}) == 24
    days = spark.sql("SELECT explode(sequence(date'2023-12-01', date'2024-03-05')) AS d").select(F.date_format("d", "yyyy-MM-dd").alias("t"))
    out = [r["p"] for r in days.select(pseudonyms.pseudonym(F.col("t"), "k").alias("p")).collect()]
    assert len(set(out)) == len(out) and all(pd.Timestamp(x) for x in out)
    digits = spark.range(100).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("t"))
    assert len({r["p"] for r in digits.select(pseudonyms.permute_digits(F.col("t"), "k", F.lit("d")).alias("p")).collect()}) == 100


# ------------------------------------------------------------------ 7 and 1


def toy(spark, n=240):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(n):
        bad = k % 3 == 0
        rows.append((k, " ".join([*rng.choice(words, 60), *(["zorgish", "stupid"] if bad else ["fine"])])))
        labels.append((k, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = toy(spark)
    odd = docs.unionByName(spark.createDataFrame([(9001, None), (9002, ""), (None, "w1 w2"), (5, "w1")], docs.schema))
    got = toxicity.toxicity(odd, labels).toPandas()
    assert len(got) == 244 and got.score.between(0, 1).all()
    held = got[got.held_out & (got.doc_id < 9000)]
    assert all(zlib.crc32(str(int(i)).encode()) % 4 == 2 for i in held.doc_id)
    assert ((held.doc_id % 3 == 0) == (held.predicted == 1)).mean() > 0.95
    none = toxicity.toxicity(docs, labels.where("false")).toPandas()
    assert (none.score == 0).all()


def test_features_do_not_depend_on_what_was_seen(spark, sf):
    lexicon = {"fool": 3.0, "zorg*": 2.0, "stupid": 3.0}
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(200).collect()] + ["You f00l, you st*pid s-t-u-p-i-d! Zorgish", "f o o l", "", "... ,"]
    seen = {}
    for t in texts:
        assert toxicity.features(t, lexicon, seen) == toxicity.features(t, lexicon)
    words = [toxicity.bare(w) for w in texts[-4].lower().split()]
    row = dict(zip(toxicity.FEATURES, toxicity.features(texts[-4], lexicon)))
    assert row["hits_per_100"] == 100 / len(words) and row["hidden_hits_per_100"] > 0 and row["insults_per_100"] == 0
    assert dict(zip(toxicity.FEATURES, toxicity.features("f o o l", lexicon)))["spelled_out_per_100"] == 25


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("k")).collect()
    share = {r["toxic"]: r["k"] / r["n"] for r in got}
    assert share[1] >= 0.8 and share[0] <= 0.03


def test_toxicity_with_odd_labels_and_long_texts(spark):
    docs, labels = toy(spark)
    more = spark.createDataFrame([(0, 1, 7), (1, None, None), (None, 1, 1)], labels.schema)
    long = spark.createDataFrame([(9100, "stupid " * 200_000), (9101, LONG)], docs.schema).withColumn("score", F.lit(1)).withColumn("features", F.lit("x"))
    got = toxicity.toxicity(docs.withColumns({"score": F.lit(0), "features": F.lit("y")}).unionByName(long), labels.unionByName(more)).toPandas()
    assert len(got) == 242 and set(got.columns) == {"doc_id", "held_out", "score", "predicted"}
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0


def test_mixing_keeps_clashing_columns(spark):
    docs, labels = toy(spark)
    more = docs.withColumns({"copies": F.lit(5), "n": F.lit(6), "id_of": F.lit(7), "H1": F.lit(8), "first_id": F.lit(9)})
    out = mixing.mix(more, labels)
    assert out.columns == more.columns and out.select("copies", "n", "id_of").distinct().collect() == [(5, 6, 7)]
    kept = simhash.drop_near_copies(more)
    assert kept.columns == more.columns and kept.select("H1", "first_id").distinct().collect() == [(8, 9)]


def test_mixing(spark):
    docs, labels = toy(spark)
    got = mixing.rates(docs.withColumnRenamed("doc_id", "id"), labels).toPandas()
    p = np.stack(got.p)
    e = (got.n * got.rate).to_numpy() @ p
    goal = mixing.ANCHOR * (got.n.to_numpy() @ p)[0]
    assert e[0] == pytest.approx(goal, rel=0.02) and e[2] == pytest.approx(goal * 0.02 / 0.93, rel=0.1)
    assert (got.rate >= 0).all() and (abs(got.copies - got.rate) < 1).all()
    out = mixing.mix(docs, labels)
    assert out.columns == docs.columns and out.count() == got.copies.sum()
    assert mixing.rates(docs.where("false").withColumnRenamed("doc_id", "id"), labels).count() == 0


def test_rates_equal_a_dense_solution(spark):
    rng = np.random.default_rng(4)
    n, p = rng.integers(1, 50, 300), rng.dirichlet([1, 1, 1], 300)
    members = spark.createDataFrame([(i, int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(n, p))], "id long, n long, p array<double>")
    goal = np.array([0.5, 0.3, 0.2]) * n.sum()
    errors, step = mixing.fit_rates(members, list(goal), passes=60)
    r, _ = mixing._fold(p, errors, step, mixing.RIDGE)
    assert np.allclose((n * r) @ p, goal, rtol=0.01)


# ------------------------------------------------------------------ all


def test_queries_are_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{k}_") for q in names) for k in range(1, 11))
    assert queries.QUERIES.keys() <= names.keys() and shared_dir(spark)
