"""Pages, archives, hosts, languages and the pipeline."""

import gzip
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.llm import hosts, html, langid, warc

SF = "/root/testdata/sf0.001"
PAGE = "page_id bigint, url string, html string, text int, host string"


@pytest.fixture(scope="module")
def tree(spark):
    return html.train(spark)


# ---- html


def test_the_tree_knows_its_samples(tree):
    for page in html.SAMPLES:
        found = html.blocks(page)
        assert [html.is_main(tree, row) for row in html.features(found)] == [b.marked for b in found]
    assert len(tree) < 2 ** (html.DEPTH + 1)


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""),
    ("<body><nav><a href=x>Home</a></nav><article><h1>Head &amp; more</h1><p>One\n  two&nbsp;three.<p>Four <b>bold</b><br>five</article><footer>Foot</footer></body>",
     "Head & more\n\nOne two three.\n\nFour bold five"),
    ("<article><p>Kept.</p><script>var x = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><form><p>Write to us now</p></form><aside>Side</aside><p title='a > b'>Kept too.</p></article>", "Kept.\n\nKept too."),
    ("<main><p>Text.</p><section id='comments'><p>A reader said a long thing here, which is not the article at all.</p></section></main>", "Text."),
    ("<body><div class='cookie-notice'>Cookies are used on this page for many good reasons</div><article><p>A</p></article><div class=advert>Buy these things today</div></body>", "A"),
    ("<nav><ul><li>unclosed menu<article><p>Text of it.</p></article>", "Text of it."),
    ("<div id=siteHeader><p>Name of the site and its motto in some words</p></div><div class=postBody><p>Yes.</p></div><div class=rightSidebar><p>Other things that might be read today</p></div>", "Yes."),
    ("<script>for(i=0;i<n;i++){f(i)}</script><article><p>Text of it.</p></article><script>if(a<b)c()</script>", "Text of it."),
    ("<body><script>var s = '<!-- no end of it';</script><article><p>Text of it.</p></article></body>", "Text of it."),
    ("<SCRIPT type=x>'</scripts>' <p</SCRIPT ><style>a<b{}</style><article><p>One.</p><script>never ends <p>two</p></article>", "One."),
    ("<article><p>One.</p><template><script>if(i<n){'</template>'}</script><p>no</p></template><svg><title>a<b</title></svg><p>Two.</p></article>", "One.\n\nTwo."),
    ("<article><p title=Bob's>First.</p><p>Ann's.</p><p alt = 'a > b' data-x=\"c > 'd\" it's>Third.</p></article>", "First.\n\nAnn's.\n\nThird."),
    *[(f"{before}<p>The first paragraph of the page has enough words to be read.</p><p>Short one.</p><p>And a third one that closes the page with some more words.</p>{after}",
       "The first paragraph of the page has enough words to be read.\n\nShort one.\n\nAnd a third one that closes the page with some more words.") for before, after in [
        ('<div class="wrap has-sidebar">', "</div>"), ('<div class="layout with-sidebar"><article>', "</article></div>"), ('<div class="site has-header-image"><main>', "</main></div>"),
        ('<div class="legal-text">', "</div>"), ("<form id=aspnetForm method=post><div id=header><a href=1>Town</a></div><div>", "</div><div id=footer>Write to us</div></form>"),
        ('<div class="sidebar-layout"><div class=post>', "</div><div class=sidebar><p>Most read today</p></div></div>"),
        ("<article>", '</article><ol class="commentlist"><li>I read this with joy and would like to add one more thing of my own to it.</li></ol>'),
        ("<main>", '</main><article class="comment"><p>I read this with joy and would like to add one more thing of my own to it.</p></article>'),
        ('<div class=post>', '</div><div class="footer-wrapper"><p>All that stands on these pages may be read by all who come here, and printed by none of them without asking first.</p></div>')]],
    ("<article><p>1 &lt; 2 &#x263A; &eacute; &amp;amp;</p></article>", "1 < 2 \u263a \u00e9 &amp;"),
])
def test_main_text(tree, page, want):
    assert html.main_text(page, tree) == want


def test_html_odd_rows(spark, tree):
    long = "<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>"
    rows = [(1, "u", long, 1, "h"), (2, None, None, None, None), (None, "u", "<p", 1, "h"), (3, "u", "<article>x</article>", 1, "h"), (3, "u", "<article>x</article>", 1, "h")]
    got = html.extract(spark.createDataFrame(rows, PAGE), tree).select("page_id", "host", "text").collect()
    assert sorted((r.page_id or 0, len(r.text)) for r in got) == [(0, 2), (1, len("\n\n".join(["word & word"] * 20_000))), (2, 0), (3, 1), (3, 1)]
    assert html.extract(spark.createDataFrame([], PAGE), tree).count() == 0


def test_articles_of_the_pages_table(spark):
    rows = {r.page_id: r for r in html.checks.queries["op1_html_text"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        assert rows[p.page_id].n_chars == len(rows[p.page_id].text)
        number = int(p.url.split("/")[4].split(".")[0].split("?")[0].split("#")[0])
        if number in texts:  # the article is the document's text, a heading before it
            want = " ".join(texts[number].split())
            assert " ".join(rows[p.page_id].text.split()).endswith(want)


# ---- warc


def read_back(spark, pages, path, **options):
    warc.write_archive(pages, path, **options)
    return warc.read_archive(spark, path)


def test_archive_round_trip(spark, tmp_path):
    rng = random.Random(2)
    big = "".join(rng.choice("ab\u00e9\u6f22\U0001f600\r\n<WARC/1.1") for _ in range(30_000))
    rows = [(1, "http://a/ b\n", big), (2, None, None), (3, "u", ""), (4, "u", big), (5, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", "y" * 100), (8, "u", "y" * 100), (None, "u", "y" * 100), (7, "u", "y" * 100)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = read_back(spark, pages, str(tmp_path / "w"), segment_bytes=1000, records_per_file=7).collect()
    assert all(r.ok for r in got) and len(got) == len(rows)
    kept = sorted((r.key, r.type, r.refers_to, bytes(r.payload).decode()) for r in got if r.type == "response")
    assert kept == sorted([("1", "response", None, big), ("2", "response", None, ""), ("3", "response", None, ""), ("5", "response", None, "x" * 99), ("6", "response", None, "x" * 99),
                           ("7", "response", None, "y" * 100), ("7", "response", None, "y" * 100)])
    assert sorted((r.key, r.refers_to) for r in got if r.type == "revisit") == [("", "7"), ("4", "1"), ("8", "7")]
    assert read_back(spark, pages.limit(0), str(tmp_path / "e")).count() == 0


def test_reassembly_checks_order_and_length(spark):
    block = warc.HTTP + warc.chunked(b"hello world" * 50)
    parts = [block[i:i + 100] for i in range(0, len(block), 100)]

    def rows(name, keep, total):
        return [(name if n == 1 else f"{name}-{n}", "response" if n == 1 else "continuation", None if n == 1 else name, n, total if n == len(parts) else None, "t", name if n == 1 else None, None, bytearray(parts[n - 1])) for n in keep]

    every = range(1, len(parts) + 1)
    data = rows("whole", reversed(every), len(block)) + rows("gap", [n for n in every if n != 3], len(block)) + rows("long", every, len(block) + 1) + rows("tail", [n for n in every if n != 1], len(block))
    got = {r.record_id: r for r in warc.decoded(warc.reassemble(spark.createDataFrame(data, warc.RECORDS))).collect()}
    assert bytes(got["whole"].payload) == b"hello world" * 50
    assert {k: v.ok for k, v in got.items()} == {"whole": True, "gap": False, "long": False, "tail": False}
    assert got["gap"].payload is None


def test_chunk_framing():
    for body in (b"", b"a", b"ab" * 10_000):
        assert warc.unchunked(warc.HTTP + warc.chunked(body, 7)) == body
    assert warc.unchunked(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"
    assert warc.unchunked(warc.HTTP + b"5;x=1\r\nabcde\r\n0\r\n\r\n") == b"abcde"
    for broken in (b"zz\r\nab\r\n", b"5\r\nab", b"2\r\nabXX0\r\n\r\n", b""):
        assert warc.unchunked(warc.HTTP + broken) is None
    one = b"".join(warc.records_of(1, "u", "x", None, 1000))
    assert len(list(warc.parse(gzip.compress(one) + gzip.compress(one)))) == 2 and list(warc.parse(b"junk")) == []


def test_malformed_archives_are_read(spark, tmp_path):
    """Bad lengths, cut blocks, bad segment numbers and damaged gzip files give records that are not ok, and no error."""
    def record(name, block, length=None, more=""):
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{name}>\r\nX-Key: {name}\r\n{more}Content-Length: {len(block) if length is None else length}\r\n\r\n{block}\r\n\r\n".encode()

    body = "HTTP/1.1 200 OK\r\n\r\nhello"
    good, odd = record("good", body), record("odd", body, "abc")
    chunk = "HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n1_0\r\n" + "x" * 16 + "\r\n0\r\n\r\n"
    files = {"a": odd + good, "b": record("seg", body, more="WARC-Segment-Number: one\r\n") + record("under", chunk), "c": record("cut", body, 5000),
             "d": gzip.compress(record("first", body)) + gzip.compress(record("second", body))[:-20], "e": gzip.compress(record("half", body * 500))[:60], "f": b"WARC/1.1\r\nno end", "g": b""}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r.key: (r.ok, r.payload and bytes(r.payload)) for r in warc.read_archive(spark, str(tmp_path)).collect()}
    assert got["good"] == (True, b"hello") and got["first"] == (True, b"hello")
    assert all(got[k] == (False, None) for k in ("odd", "seg", "under", "cut"))
    assert not any(ok for k, (ok, _) in got.items() if k not in ("good", "first", "second"))


@pytest.mark.parametrize("module, name", [(warc, "op5_warc_reassembly"), (hosts, "op4_host_reputation")])
def test_equals_sql(spark, module, name):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = module.checks.queries[name](spark, SF)
    cur = con.execute(module.checks.sql[name])
    names = [d[0] for d in cur.description]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, (tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall())))


@pytest.mark.parametrize("rows", [
    [(7, "A"), (None, "A"), (None, "B")], [(7, "A"), (9, "C"), (None, "A"), (None, "C")], [(7, "A"), (7, "B"), (9, "A"), (9, "B"), (9, "C"), (9, "C")],
    [(None, "A"), (None, "A"), (None, "B"), (5, "b"), (None, "b"), (4, "b")], [(3, "A"), (2, "B"), (2, "A"), (3, "B"), (3, "A"), (1, None), (1, "B")]])
def test_null_and_repeated_ids_of_different_payloads(spark, as_dir, rows):
    """An id is not a payload: every row keeps its own. Small letters stand for payloads that are too short for a revisit."""
    pages = [(i, f"u{n}", p and p * (150 + ord(p) if p.isupper() else 20)) for n, (i, p) in enumerate(rows)]
    d = as_dir(pages=spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{d}/pages.parquet/*.parquet'")
    cur = con.execute(warc.checks.sql["op5_warc_reassembly"])
    names = [c[0] for c in cur.description]
    got = warc.checks.queries["op5_warc_reassembly"](spark, d)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[names.index(c)] for c in got.columns)) for r in cur.fetchall())


# ---- hosts


def test_urls_and_rules(spark):
    cases = {"HTTP://WWW.Example.COM/en/x?y": ("www.example.com", "/en/x", "www.example.com/en/", "allow"), "http://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
             "x://example.com#/en/": ("example.com", "", None, "allow"), "http://a.net/es/1": ("a.net", "/es/1", "net/es/", "block"), "http://net/fr/": ("net", "/fr/", "net/fr/", "block"),
             "http://xnet/fr/": ("xnet", "/fr/", None, "allow"), "http://b.com/": ("b.com", "/", "com/", "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
             "http://a.org?u=http://b.com/": ("a.org", "", None, "allow"), "http://\u00c9.com/": ("\u00c9.com", "/", "com/", "allow")}
    pages = spark.createDataFrame([(u, 1, "x") for u in cases], "url string, host int, domain string")
    none = spark.createDataFrame([], "url string, bad int")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in hosts.judge(pages, none).collect()}
    assert got == cases
    assert hosts.judge(pages.limit(0), none).count() == 0


def test_bad_hosts_are_blocked_and_small_ones_shrunk(spark):
    rows = [(f"http://bad.x.org/{i}", 1) for i in range(200)] + [(f"http://good.y.org/{i}", 0) for i in range(2000)] + [("http://one.y.org/1", 1), ("http://lone.z.org/1", 1)]
    outcomes = spark.createDataFrame(rows, "url string, bad int")
    pages = spark.createDataFrame([(u,) for u in ("http://bad.x.org/n", "http://good.y.org/n", "http://one.y.org/n", "http://new.y.org/n", "http://new.x.org/n", "http://else.com2/n")], "url string")
    got = {r.url.split("/")[2]: r for r in hosts.judge(pages, outcomes).collect()}
    assert got["bad.x.org"].verdict == "block" and {got[h].verdict for h in ("good.y.org", "new.y.org", "else.com2")} == {"allow"}
    assert got["good.y.org"].bad_rate < got["new.y.org"].bad_rate + 1e-9 < got["one.y.org"].bad_rate < 1 and got["new.x.org"].bad_rate > got["new.y.org"].bad_rate
    assert all(r.bound <= r.bad_rate for r in got.values())


# ---- languages


def plain_bits(train, text):
    """Code length by following the escapes byte by byte."""
    from collections import Counter, defaultdict
    tree = defaultdict(Counter)
    for t in train:
        for i in range(len(t)):
            for k in range(min(i, langid.ORDER) + 1):
                tree[t[i - k:i]][t[i]] += 1
    import math
    total = 0.0
    for i, b in enumerate(text):
        for k in range(min(i, langid.ORDER), -1, -1):
            own = tree.get(text[i - k:i])
            if own is None:
                continue
            n, kinds = sum(own.values()), len(own)
            if b in own:
                total += math.log2((n + kinds) / own[b])
                break
            total += math.log2((n + kinds) / kinds)
        else:
            total += 8
    return total


def test_code_lengths_are_exact(spark):
    rng = random.Random(8)
    texts = {"aa": ["abracadabra", "abcabcabd", "\u00e9t\u00e9"], "bb": ["xyzzy xyz", "zzyx"]}
    docs = spark.createDataFrame([(lang, t) for lang, own in texts.items() for t in own], "lang string, text string")
    model = langid.build(langid.context_counts(docs))
    for _ in range(40):
        t = "".join(rng.choice("abcdrxyz \u00e9Q") for _ in range(rng.randint(0, 30))).encode()
        assert model.bits([t])[0] == pytest.approx([plain_bits([x.encode() for x in texts[lang]], t) for lang in model.languages], rel=1e-4)
    long = ("abra" * 40_000).encode()
    assert model.bits([long])[0][0] == pytest.approx(plain_bits([x.encode() for x in texts["aa"]], long), rel=1e-3)


def test_held_out_accuracy(spark):
    df = langid.checks.queries["op3_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = df.join(truth, "doc_id").filter("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows) > 100
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, odd_docs, no_docs):
    model = langid.train(spark.createDataFrame([(i, "the and of to that", "en", "x", 1) for i in range(8)] + [(i, "der und die das ist", "de", "x", 1) for i in range(8)], odd_docs.schema))
    got = langid.predict(odd_docs.withColumn("score", F.lit("old")), model).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not letters) and (r.score == 0) == (not letters)
    assert langid.predict(no_docs, model).count() == 0
    untrained = langid.train(no_docs)
    assert {r.lang_pred for r in langid.predict(odd_docs, untrained).collect()} == {"und"}
    import zlib
    ids = [*range(50), None]
    held = {r.i: r.h for r in spark.createDataFrame([(i,) for i in ids], "i bigint").select("i", langid.held_out(F.col("i")).alias("h")).collect()}
    assert held == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}


def test_a_language_of_long_texts_is_learnt(spark, odd_docs):
    long = {"en": "the and of to that was ", "de": "der und die das ist f\u00fcr "}
    docs = spark.createDataFrame([(i, long["en"], "en", "x", 1) for i in range(8)] + [(i, long["de"] * 2000, "de", "x", 1) for i in range(8, 16)], odd_docs.schema)
    model = langid.train(docs)
    assert model.languages == ["de", "en"]
    assert {r.lang for r in langid.predict(docs, model).filter("lang = lang_pred").collect()} == {"de", "en"}
    # whole texts are counted; a budget below one text still leaves every language one
    counts = langid.context_counts(docs.filter("doc_id = 8"))
    assert sum(n for _, gram, n in counts if len(gram) == 1) == len((long["de"] * 2000).encode())
    assert langid.train(docs, bytes_per_lang=1).languages == ["de", "en"]


# ---- pipeline


def test_pipeline_stages(spark, odd_docs, as_dir):
    """Each decision takes effect on planted rows, and clean documents come through."""
    import corpus_pipeline as P
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars > 400").limit(60)
    rng = random.Random(6)
    item = " ".join(f"bench{rng.randrange(999)}" for _ in range(40))
    base = real.orderBy("doc_id").first()
    planted = [(9001, base.text, "en", "s", 1), (9002, None, "en", "s", 1), (9003, "12 ### 34", "en", "s", 1), (9004, f"one of the {item} and that", "en", "s", 1),
               (9005, "here is the token = \"abcdefghij0123456789\" and nothing else of note", "en", None, 1), (9005, "here is the token = \"abcdefghij0123456789\" and nothing else of note", "en", None, 1)]
    docs = real.unionByName(spark.createDataFrame(planted, odd_docs.schema))
    d = as_dir(documents=docs, benchmark=spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string"))
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "mixture"]
    got = P.run(spark, d).collect()
    by = {r.doc_id: r for r in got}
    assert len(by) == len(got) and not {9001, 9002, 9003, 9004} & set(by)
    assert by[9005].text == 'here is the [assign]" and nothing else of note' and by[9005].n_chars == len(by[9005].text)
    before = {r.doc_id: r.text for r in docs.collect()}
    assert len(by) >= 0.9 * len({r.text for r in real.collect()}) and all(before[i] == r.text for i, r in by.items() if "[" not in r.text)
    assert len({r.position for r in got}) == len(got)


def test_pipeline_of_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    import corpus_pipeline as P
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        d = str(tmp_path / name)
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
        stage = docs
        for _, fn in P.STAGES[:-1]:
            stage = fn(spark, stage, d)
            assert stage.columns == docs.columns
        ids = [r.doc_id for r in P.run(spark, d).collect()]
        assert len(ids) == len(set(ids)) and (name == "odd") == bool(ids)


def test_near_dedup_keeps_unlinked_texts_of_one_id(spark, odd_docs):
    import corpus_pipeline as P
    rng = random.Random(12)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    rows = [(2, b, "en", "s", 1), (1, b, "en", "s", 1), (1, a, "en", "s", 1), (1, a, "en", "s", 1), (3, a, "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "s", 1)]
    got = P.near_dedup(spark, spark.createDataFrame(rows, odd_docs.schema), "")
    assert got.columns == odd_docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(1, a), (1, b), (0, c)])


def test_near_dedup_drops_what_the_simhash_operator_links(spark, odd_docs):
    """Texts within three bits are copies also below the similarity of shingle sets, and meet those that only the sets link."""
    import numpy as np
    import corpus_pipeline as P
    from barloom.llm import neardup, simhash
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    bits = lambda a, b: int(np.bitwise_count(np.bitwise_xor(*simhash.fingerprint([a, b], 3))))
    alike = lambda a, b: neardup.similarity(neardup.shingles(a), neardup.shingles(b)) >= 0.8
    while True:
        first = [word() for _ in range(300)]
        second = [word() if k % 60 == 7 else w for k, w in enumerate(first)]
        one, two, three = " ".join(first), " ".join(second), " ".join(second * 8 + [word() for _ in range(120)])
        if bits(two, three) <= 3 < min(bits(one, two), bits(one, three)):
            break
    assert alike(one, two) and not alike(two, three) and not alike(one, three)
    other = " ".join(word() for _ in range(80))
    rows = [(7, three, "en", "s", 1), (5, two, "en", "s", 1), (6, one, "en", "s", 1), (8, other, "en", "s", 1), (None, three, "en", "s", 1)]
    got = P.near_dedup(spark, spark.createDataFrame(rows, odd_docs.schema), "")
    assert sorted(r.doc_id for r in got.collect()) == [5, 8]


def test_digest_is_of_the_payload(spark, tmp_path):
    row = spark.createDataFrame([(1, "u", "\u00e9" * 200)], "page_id bigint, url string, html string")
    got = read_back(spark, row, str(tmp_path / "d")).first()
    assert hashlib.sha256(bytes(got.payload)).hexdigest() == hashlib.sha256(("\u00e9" * 200).encode()).hexdigest()


def test_context_counts_reach_the_driver_as_arrow(spark, monkeypatch):
    docs = spark.createDataFrame([("en", "abab"), ("en", "ab"), ("de", "é")], "lang string, text string")

    def pickled(self, *args):
        raise AssertionError("a table reached the driver as pickled rows")

    monkeypatch.setattr(type(docs), "toPandas", pickled)
    monkeypatch.setattr(type(docs), "collect", pickled)
    got = sorted(langid.context_counts(docs, 1))
    assert got == [("de", b"\xa9", 1), ("de", b"\xc3", 1), ("de", b"\xc3\xa9", 1), ("en", b"a", 3), ("en", b"ab", 3), ("en", b"b", 3), ("en", b"ba", 1)]
