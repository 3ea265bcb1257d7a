"""Operators on pages, the pipeline, and the SQL oracles of this folder."""
import base64
import gzip
import hashlib
import io
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tapeloom.llm.style_tree import extract_main_text, parse
from tapeloom.llm.url_rules import SITE_RULES, Rule, filter_urls, literals, site_rule, word_rule
from tapeloom.llm.warc import CorruptArchive, read_archives, read_records, record, write_archives

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations".split()


@pytest.mark.parametrize("page,blocks", [
    ("<p>a<b>b</b> c<br>d<p>e &amp;&lt; f</p>", ["ab c d", "e &< f"]),
    ("<body><nav>n</nav><article><h1> T\n t</h1><p>one <a href='x>y'>two</a></p><div class='ad'>AD</div><section id=comments><p>c</p></section></article><footer>x", ["T t", "one two"]),
    ("<div><span class='cookie-notice'>n</span>text<script>var t='</p>';</script> more</div>", ["text more"]),
    ("<title>t</title><style>p{}</style><!-- c --><p>x", ["x"]),
    ("plain < 5 text &eacute;&#233;", ["plain < 5 text éé"]),
    ("<ul><li>x<li>y</ul><table><tr><td>1<td>2</table>", ["x", "y", "1", "2"]),
    ("<article><p>a</p><form><input><p>f</form>tail</article>", ["a", "tail"]),
    ("<p>unclosed <b>bold<p>next</b> one", ["unclosed bold", "next one"]),
    ("<script>never closed", []), ("<p attr=\"never closed>text", ["text"]), ("", []), ("<!-- open", []),
])
def test_blocks_of_a_page(page, blocks):
    assert [text for _, _, text in parse(page)] == blocks


@pytest.mark.parametrize("inner,blocks", [
    ("<h2 id='related-work'>r</h2><section id='search-algorithms'><p>s</p></section><div class='side-by-side'>d</div><p id='comments-on-method'>c</p>", ["r", "s", "d", "c"]),
    ("<section id=discussion><p>d</p></section><h2 class=notice>n</h2><p class='side'>p</p><header><h1>t</h1></header>", ["d", "n", "p", "t"]),
    ("<p>let <math><mi>x</mi></math> be</p>", ["let x be"]),
    ("<div class='big ad'>AD</div><div role=search>s</div><div class='ad-free'>f</div><p hidden>h</p><script>x</script>", ["f"]),
])
def test_article_text_is_not_dropped_by_parts_of_names(inner, blocks):
    for tag in ("article", "main"):
        assert [text for _, _, text in parse(f"<{tag}>{inner}</{tag}>")] == blocks


@pytest.mark.parametrize("inner,blocks", [
    ('<p><a href="/hidden-valley">Hidden Valley</a> is a ski resort.</p>', ["Hidden Valley is a ski resort."]),
    ('<p title="Hidden treasure">The treasure was found.</p>', ["The treasure was found."]),
    ("<p data-class=ad>a</p><p title='class=ad hidden'>b</p><p data-x='role=search'>c</p><div aria-hidden=false>d</div><div hidden-x>e</div>", ["a", "b", "c", "d", "e"]),
    ('<p title="a > b" hidden>h</p><div aria-hidden="true">i</div><div HIDDEN>j</div><p x="1"hidden>k</p><p>z</p>', ["z"]),
    ("<div class='share-price'>s</div><div class='menu-item-description'>m</div><p class='alert-level'>a</p>", ["s", "m", "a"]),
    ("<div class='comment-list'>s</div><div class='user-comment'>m</div><div id='comment-12'>a</div><div class='x comments_section'>c</div><p>z</p>", ["z"]),
    ("<div class='nav-bar top'>n</div><div class='ad-slot-3'>a</div><div class='sidebar_left'>s</div><p>z</p>", ["z"]),
])
def test_attributes_are_names_with_values(inner, blocks):
    for tag in ("article", "main", "div"):
        assert [text for _, _, text in parse(f"<{tag}>{inner}</{tag}>")] == blocks


def test_small_hosts_lean_on_the_same_style_elsewhere(spark):
    page = lambda host, i: f"<div><div><span>Terms of {host}</span></div><div><p>Story {i} of {host}</p></div><table><tr><td>Prices {host}</td></tr></table></div>"
    rows = [(f"{host}{i}", f"http://{host}.example/{i}", page(host, i)) for host, n in (("one", 1), ("two", 2), ("nine", 9), ("ten", 10), ("fifty", 50)) for i in range(n)]
    # A small host with a layout of its own keeps it, even where its pages agree.
    rows += [(f"own{i}", f"http://own.example/{i}", f"<section><h2>Same words</h2><p>Own story {i}</p></section>") for i in range(3)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    for host, n in (("one", 1), ("two", 2), ("nine", 9), ("ten", 10), ("fifty", 50)):
        for i in range(n):
            assert got[f"{host}{i}"] == f"Story {i} of {host}"
    assert got["own1"] == "Same words\n\nOwn story 1"


def test_furniture_inside_articles_goes_and_long_paths_differ(spark):
    deep = lambda name: f"<div class='{name}'>" + "<div class='{}'>".format("x" * 50) * 10
    rows = [(i, f"http://a.example/{i}", f"<article><h1>Title {i}</h1><div class='z'>Read our terms</div><p>Text {i}</p>{deep('one')}Same</div>{'</div>' * 10}{deep('two')}Own {i}{'</div>' * 11}</article>") for i in range(8)]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Title {i}\n\nText {i}\n\nOwn {i}" for i in range(8)}


def test_site_furniture_goes_and_articles_stay(spark):
    rng = random.Random(1)
    body = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(30))
    rows = [(i, f"http://Site.example/{i}", f"<body><div class='x1'>All rights reserved by us</div><div class='main-col'><p>{body()}</p></div></body>", "old") for i in range(8)]
    rows += [(20 + i, f"http://two.example/{i}", f"<body><article><p>shared words</p><p>{body() if i else 'only'}</p></article></body>", "old") for i in range(8)]
    rows += [(90, None, None, "o"), (91, "no scheme", "", "o"), (92, "http://lone.example/", "<p>All rights reserved by us</p>", "o"), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract_main_text(pages)
    got = {r.page_id: r for r in out.collect()}
    assert out.count() == len(rows) and out.columns == ["page_id", "url", "text", "n_chars"]
    for i in range(8):
        assert "reserved" not in got[i].text and len(got[i].text) > 100
        assert got[20 + i].text.startswith("shared words\n\n")
    assert got[90].text == got[91].text == "" and got[92].text == "All rights reserved by us" and got[92].n_chars == 25
    assert extract_main_text(pages.limit(0)).count() == 0


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate({i: i + 32 for i in range(65, 91)})
    best = None
    for verdict, site, prefix in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")):
        if (host == site or host.endswith("." + site)) and path.startswith(prefix) and (best is None or len(site + prefix) > len(best[0])):
            best = site + prefix, verdict
    if best:
        return host, path, *best
    return host, path, None, "block" if "casino" in re.split(r"[.\-]", host) else "allow"


@pytest.mark.parametrize("pattern,tokens", [
    (site_rule("allow", "example.org", "/en/1").pattern, ("example", "org", "en")), (word_rule("block", "bets").pattern, ("bets",)), (r"^ads?\.", ()), (r"/track(er)?/", ()),
    (r"/a1/(b2|c3)/d4$", ("a1", "d4")), (r"/x[0-9]/y/", ("y",)), (r"(?i)/ads/", ()), (r"/(?:foo)/+bar/", ("foo", "bar")), (r"/(ab/cd/){2,}", ("cd",)), (r"\bads\b", ()), (r"/a(?=b)/", ()),
    (r"[", ()), (r".*", ()), (r"^([^\n]*\.)?net\n", ("net",)), (r"^(www)?com\n", ()), (r"/p[.-]q/", ("p", "q")), (r"/é/x/", ("x",)), (r"/end", ()), (r"[^/]mid/", ()), (r"/(?i:up)/low/", ("low",)),
])
def test_literals_of_any_expression(pattern, tokens):
    assert literals(pattern) == tokens


def test_literals_stand_whole_in_every_match():
    rng = random.Random(6)
    parts = ["/", "a", "b1", ".", "-", "[.-]", "[a-c]", "(x|y)", "(/|$)", "(ab/)?", "(/c)?", "q*", "/+", "(d/)+", "^", "$", "\n", "[^/]", "(-|.)"]
    texts = ["".join(rng.choice(["/", ".", "-", "\n", "a", "b1", "c", "d", "x", "y", "q", "ab"]) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    hits = 0
    for _ in range(1500):
        pattern = "".join(rng.choice(parts) for _ in range(rng.randint(2, 6)))
        wanted = set(literals(pattern))
        for text in texts if wanted else ():
            if re.search(pattern, text):
                hits += 1
                assert wanted <= set(re.findall("[A-Za-z0-9]+", text)), (pattern, text)
    assert hits > 50


def test_rules_from_a_table(spark):
    urls = ["http://a.com/ads/1", "http://a.com/x/track-7/y", "http://shop.net/ADS/", "http://b.org/", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [Rule("ads", "block", r"/ads/", 5), Rule("track", "block", r"/track-\d+/", 5), Rule("shop", "allow", r"^shop\.", 9), Rule("shopads", "block", r"(?i)/ads/", 1)]
    table = spark.createDataFrame([(r.name, r.verdict, r.pattern, r.rank) for r in rules] + [("null", "block", None, 1)], "rule string, verdict string, pattern string, rank int")
    listed = [tuple(r) for r in filter_urls(pages, rules).orderBy("page_id").select("rule", "verdict").collect()]
    assert listed == [("ads", "block"), ("track", "block"), ("shop", "allow"), (None, "allow"), (None, "allow")]
    assert [tuple(r) for r in filter_urls(pages, table).orderBy("page_id").select("rule", "verdict").collect()] == listed
    assert filter_urls(pages, table.limit(0)).filter("rule IS NOT NULL").count() == 0


def test_url_rules_equal_brute_force(spark):
    urls = [f"{scheme}://{host}{path}" for scheme in ("http", "HTTPS") for host in ("example.org", "WWW.Example.org", "badexample.org", "org", "a.com", "com", "casino-win.net", "mycasino.net", "x.net:80", "")
            for path in ("", "/", "/es/1", "/en/1", "/en/15?x=/es/", "/en/2", "/fr/", "/de/x#y", "/DE/", "?q=/de/", "#/de/", "/a://b.com/de/")]
    urls += [None, "", "no scheme.com/de/", "a://b://c.com/de/", "://com/de/", "http://com\n/de/"]
    rows = [(i, u, "old") for i, u in enumerate(urls)] + [(3, urls[3], "old")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    out = filter_urls(pages, SITE_RULES + (word_rule("block", "casino"),)).collect()
    assert len(out) == len(rows)
    for r in out:
        rule = None if (r.rule or "").startswith("*") else r.rule
        assert (r.host, r.path, rule, r.verdict) == judged(r.url), r.url
    assert {r.verdict for r in filter_urls(pages, ()).collect()} == {"allow"}
    assert filter_urls(pages.limit(0)).count() == 0


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "same"), (2, "http://b/\r\nX", "same"), (3, None, "é" * 5000), (4, "u", None), (5, "u", ""), (None, "n", "same"), (2, "again", "same"), (7, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archives = write_archives(pages, str(tmp_path), archive_bytes=2_000)
    got = read_archives(archives, str(tmp_path)).collect()
    assert len(got) == len(rows) == sum(r.records for r in archives.collect())
    by_id = {r.page_id: r for r in got}
    for page_id, _, html in rows:
        body = (html or "").encode()
        r = by_id[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        want = {1: 2, None: 2, 4: 5}.get(page_id)
        assert (r.record_type, r.refers_to) == (("revisit", want) if want else ("response", None))
        assert r.payload is None if want else bytes(r.payload) == body
    plain = write_archives(pages, str(tmp_path / "long"), least_bytes=5)
    assert {r.record_type for r in read_archives(plain, str(tmp_path / "long")).collect() if r.page_id in (1, 2, 4, 5)} == {"response"}
    assert read_archives(write_archives(pages.limit(0), str(tmp_path)), str(tmp_path)).count() == 0


def test_reader_is_sequential_and_strict():
    good = record(1, "u", b"payload", None, False)
    assert [r["payload"] for r in read_records(io.BytesIO(good + record(2, "v", b"", None, False)))] == [b"payload", b""]
    text = gzip.decompress(good)
    for broken in (gzip.compress(text.replace(b"payload", b"paylOad")), good[:-20], gzip.compress(text[:-6]), gzip.compress(text + b"x"), gzip.compress(b"HTTP/1.1 200\r\n\r\n")):
        with pytest.raises(CorruptArchive):
            list(read_records(io.BytesIO(broken)))


def _foreign(kind, block, **head):
    lines = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in {"WARC-Type": kind, "WARC-Target-URI": "http://x/", **head, "Content-Length": len(block)}.items())
    return gzip.compress(b"WARC/1.0\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n")


def test_records_of_other_writers():
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n"
    parts = [_foreign("warcinfo", b"software: x\r\n"), _foreign("request", b"GET / HTTP/1.1\r\n\r\n"), _foreign("response", http + b"\r\nplain"),
             _foreign("response", http + b"Transfer-Encoding: chunked\r\n\r\n4;x=y\r\nabcd\r\n10\r\n0123456789abcdef\r\n0\r\n\r\n"), _foreign("metadata", b""),
             _foreign("response", http + b"Content-Length: 900\r\n\r\ncut", WARC_Truncated="length", WARC_Payload_Digest="sha1:AAAA"), _foreign("response", b"no header at all"),
             _foreign("response", http + b"\r\nother hash", WARC_Payload_Digest="md5:00"), _foreign("revisit", http + b"\r\n"), record(9, "u", b"own", None, False)]
    got = list(read_records(io.BytesIO(b"".join(parts))))
    assert [r["payload"] for r in got] == [b"plain", b"abcd0123456789abcdef", b"cut", b"no header at all", b"other hash", None, b"own"]
    assert [r["page_id"] for r in got] == [None] * 6 + [9] and got[5]["record_type"] == "revisit" and got[5]["payload_digest"] is None
    assert got[0]["payload_digest"] == base64.b32encode(hashlib.sha1(b"plain").digest()).decode() and got[1]["payload_bytes"] == 20
    for broken in (_foreign("response", http + b"Content-Length: 9\r\n\r\nshort"), _foreign("response", http + b"Transfer-Encoding: chunked\r\n\r\nzz\r\n"),
                   _foreign("response", http + b"Transfer-Encoding: chunked\r\n\r\nff\r\nabc"), gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\n\r\n")):
        with pytest.raises(CorruptArchive):
            list(read_records(io.BytesIO(broken)))


def test_a_revisit_names_the_record_it_repeats():
    text = gzip.decompress(record(1, "u", b"same", 2, True)).decode()
    original = re.search("WARC-Record-ID: (.*)\r", gzip.decompress(record(2, "v", b"same", None, False)).decode())[1]
    assert f"WARC-Refers-To: {original}\r\n" in text


def test_reading_tasks_grow_with_the_archives_and_errors_are_rows(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"page {i} " * 50) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash")).withColumn("name", F.lit("clash")).repartition(4)
    archives = write_archives(pages, str(tmp_path), archive_bytes=1)
    read = read_archives(archives, str(tmp_path))
    assert archives.count() == 40 and read.rdd.getNumPartitions() >= 4 and read.count() == 40
    assert read.select(F.spark_partition_id().alias("p")).distinct().count() >= 4
    paths = sorted(r.path for r in archives.collect())
    with open(paths[0], "ab") as broken:
        broken.write(b"junk")
    got = read_archives(archives, str(tmp_path), with_errors=True).collect()
    assert len(got) == 41 and [r.url for r in got if r.error] == [paths[0]]
    assert read_archives(archives.limit(0), str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["op3_source_mixture", "op8_url_filter", "op9_decontamination", "op10_warc", "op12_conversation_trie", "op13_spelling_variants"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    got = entry.queries()[name](spark, SF).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cursor.fetchall())) and got


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(os.path.join(SF, "documents.parquet"))
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = corpus_pipeline.staged(stage(spark, docs, SF))
        assert docs.columns == columns, name
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == sizes[4] and set(columns) < set(out.columns)


def test_pipeline_stages_leave_columns_of_any_name_alone(spark):
    """Columns named like what a stage adds or uses within come through as they went in."""
    docs = spark.read.parquet(os.path.join(SF, "documents.parquet")).limit(80)
    names = ["n_words", "kept", "base_failed", "quality_probability", "replica", "shuffle_key", "__high", "__low", "__row", "__id", "class", "__in_0", "n_hit", "contaminated", "__steps", "head", "text_"]
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"mine{i}"), F.col("doc_id").cast("string")))
    docs = corpus_pipeline.staged(docs)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, SF))
        assert docs.columns == columns, name
        for r in docs.collect():
            assert all(r[c] == f"mine{i}{r.doc_id}" for i, c in enumerate(names)), name
    assert docs.count() > 0


def test_pipeline_takes_an_empty_table(spark):
    docs = spark.read.parquet(os.path.join(SF, "documents.parquet")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF))
    assert docs.count() == 0


def test_all_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([name for name in names if name.startswith(f"op{n}_")]) == 1
