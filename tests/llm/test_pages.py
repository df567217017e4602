import gzip
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loghaven.llm import html_blocks as H
from loghaven.llm import page_diff, url_rules, warc
from loghaven.llm.common import scratch_path

# -- WARC ---------------------------------------------------------------------------


def web_rows():
    rng = random.Random(4)
    rows = [(i, f"http://h{i % 3}.example/{i}", "<p>" + "é x " * rng.randint(1, 400)) for i in range(30)]
    rows += [(100 + i, "http://copy.example/", rows[3][2] + "z" * 100) for i in range(5)]
    rows += [(200, None, None), (201, "", ""), (202, "u", None), (203, "http://a/", "short"), (204, "http://b/", "short"), (205, "bad url\r\nX: y", "WARC/1.1\r\n\r\n" * 20), (206, "x", "🙂" * 5000)]
    rows += [(100, "http://copy.example/", rows[3][2] + "z" * 100), (None, "n", rows[3][2] + "z" * 100), (None, "m", "q" * 200), (None, "m", "q" * 200)]
    return rows


def expected_records(rows):
    size = lambda t: len((t or "").encode())
    least = {}
    for i, _, t in rows:
        if i is not None and size(t) >= 100:
            least[t] = min(i, least.get(t, i))
    out = Counter()
    for i, _, t in rows:
        first = least.get(t)
        again = first is not None and i != first
        out[i, size(t), hashlib.sha256((t or "").encode()).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    return out


@pytest.mark.parametrize("kw", [{}, {"segment_chars": 333, "records_per_file": 7}])
def test_round_trip(spark, kw):
    rows = web_rows()
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, size int, digest string")
    path = scratch_path(spark, "warc-test")
    warc.write_warc(pages, path, **kw)
    found = warc.read_warc(spark, path, keep_payload=True).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == expected_records(rows)
    assert all(hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"] for r in found)
    files = spark.read.format("binaryFile").load(path).collect()
    kinds = Counter(f["warc-type"] for x in files for f, _ in warc.parse(bytes(x["content"])))
    assert kinds["revisit"] == sum(n for k, n in expected_records(rows).items() if k[3] == "revisit") and (kinds["continuation"] > 0) == bool(kw)
    plain = [f for x in files for f, _ in warc.parse(gzip.decompress(bytes(x["content"])))]
    assert len(plain) == sum(kinds.values())


def test_empty_table(spark):
    path = scratch_path(spark, "warc-empty")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).collect() == []


def test_damage_is_an_error(spark, tmp_path):
    records = list(warc.records_of("<urn:x>", 1, "u", "a" * 500, hashlib.sha256(b"a" * 500).hexdigest(), None, 100))
    whole = [r.encode() + b"\r\n\r\n" for r in records]
    for name, parts, text in (("gap", whole[:1] + whole[2:], "not complete"), ("cut", [b"".join(whole)[:-10]], "ends inside"), ("last", whole[:-1], "not complete")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(b"".join(parts))
        with pytest.raises(Exception, match=text):
            warc.read_warc(spark, str(tmp_path / name)).collect()
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "x.warc").write_bytes(b"".join(reversed(whole)))  # any order of segments
    assert warc.read_warc(spark, str(tmp_path / "ok")).first()["payload_bytes"] == 500
    with pytest.raises(ValueError, match="digest"):
        warc._digest(b"x", "0" * 64, "r")


# -- HTML ---------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="home page"><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></ul></nav><div id="cookie-notice">We use cookies</div><div class="left sidebar"><p>side</div>
<main><article class="post"><header><h1>Title &amp; more</h1></header><p>A &lt;b&gt;<br>c <b>d</b>e
   f<script>var a="</p>";</script></p><div class="ad-slot"><p>buy</p></div><ul><li>one<li>two</ul><form>f<input></form>
<blockquote>q&nbsp;r</blockquote><aside>x</aside></article><section id="comments"><article class="comment"><p>hi</p></article></section></main><footer>&copy; f</footer><!-- <p>no</p> --></body>"""


def test_blocks():
    assert "\n".join(H.article_lines(list(H.blocks(PAGE)))[0]) == "Title & more\nA <b> c de f\none\ntwo\nq r"
    assert list(H.blocks("")) == [] and [b.text for b in H.blocks("<p>a<p>b<!-- c")] == ["a", "b"] and [b.text for b in H.blocks("x < y &am &quo")] == ["x < y &am &quo"]
    assert [b.text for b in H.blocks('<p>a</p><a href="x>rest of <b>page</b>')] == ["a", "rest of page"]  # no markup, whatever the quotes
    assert [b.text for b in H.blocks("<div class=ad/>x</div><a href=http://h/>y</a>" + "<i t='" * 3)] == ["x", "y"]
    assert H.article_lines(list(H.blocks("<p>a</p><div class=content><p>b</div>")))[0] == ["b"]


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(500):
        x, y = ([rng.choice("abcde") for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
        got = H.shared_lines(x, y)
        rest = iter(y)
        assert len(got) == table[-1][-1] and all(x[i] in rest for i in sorted(got))
    # very many shared lines, in other order: the same method in little memory
    rng = random.Random(2)
    x, y = ([rng.randrange(3000) for _ in range(20_000)] for _ in range(2))
    got, rest = sorted(H.shared_lines(x, y)), iter(y)
    assert len(got) == int(H._lengths(x, y)[-1]) and all(x[i] in rest for i in got)
    assert len(H.shared_lines(list(range(5000)), list(range(4999, -1, -1)))) == 1


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_differencing(spark, parts):
    rng = random.Random(3)
    rows = [(i, f"http://{rng.choice(['a', 'b'])}.example/{rng.choice('xy')}/{i:03d}", None) for i in range(40)]
    rows = [(i, u, f"<div>menu {u[7]}</div><p>unique {i}</p><p>foot {u[7]}</p>") for i, u, _ in rows]
    rows += [(50, "http://c.example/1", "<p>alone</p>"), (51, None, None), (52, "http://a.example/x/0000", "<article>menu a</article><p>z</p>")] + [rows[0]] * 2
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame([(*r, "p") for r in rows], "page_id long, url string, html string, part string")
        found = page_diff.extract(df).collect()
        assert page_diff.extract(df.limit(0)).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    got = {r["page_id"]: r["text"] for r in found}
    assert got[50] == "alone" and got[51] == "" and got[52] == "menu a"
    assert sum(got[i] == f"unique {i}" for i in range(1, 40)) >= 38


@pytest.mark.parametrize("parts", [1, 8])
def test_copies_lose_the_same_lines(spark, parts):
    """Runs of copies under one path and several: every copy is compared with a page that differs."""
    page = "<div>menu</div><p>same text</p><p>foot</p>"
    rows = [(i, "http://h.example/news/a", page) for i in range(30)] + [(100 + i, f"http://h.example/news/b{i}", page) for i in range(5)]
    rows += [(200, "http://h.example/news/c", "<div>menu</div><p>other text</p><p>foot</p>"), (201, "http://h.example/news/aa", "<article>menu</article>")]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["page_id"]: r["text"] for r in page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len({got[i] for i, _, html in rows if html == page}) == 1 and "same text" in got[0]
    assert got[0] == "same text\nfoot" and got[200] == "other text\nfoot" and got[201] == "menu"


# -- URL rules ------------------------------------------------------------------------


def judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = rest[: min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))]
        rest = rest[len(host) :]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("n", [4, 3000])
def test_url_rules(spark, n):
    rng = random.Random(2)
    label = lambda: rng.choice(["a", "b", "net", "com", "org", "example", "x" * rng.randint(1, 3)])
    name = lambda k: ".".join(label() for _ in range(rng.randint(1, k)))
    rules = url_rules.RULES if n == 4 else list({(h, p): (h, p, rng.choice(["block", "allow"])) for h, p in ((name(3), "/" + "/".join(label() for _ in range(rng.randint(0, 3)))) for _ in range(n))}.values())
    urls = [f"http{rng.choice(['', 's'])}://{name(4)}{rng.choice(['', '/', '/en/', '/de/x', '/fr/', '/a/b/net?q=/x', '#f', '?a', '/' + label() + '/' + label()])}" for _ in range(1500)]
    urls += [None, "", "nourl", "://", "http://", "http:///p", "HTTP://WWW.Example.NET/en/X", "http://EXAMPLE.ÑET/", "http://a..net/en/", "x://y://z/q", "http://u@example.net:80/en/", "http://example.net"] + ["http://hot.example.net/en/1"] * 400
    pages = spark.createDataFrame([(i, u, "k", 1) for i, u in enumerate(urls)], "page_id long, url string, key string, range int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: judge(u, rules) for i, u in enumerate(urls)}


def test_control_tables_are_literals(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.example.net/en/"), (2, None)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    found = url_rules.op5_url_filters(spark, str(tmp_path))
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan and "LogicalRDD" not in plan
    assert {r["page_id"]: r["rule"] for r in found.collect()} == {1: "example.net/en/", 2: None}


def test_url_edges(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/"), (None, None)], "page_id long, url string")
    assert {r["verdict"] for r in url_rules.judge_urls(pages, none, default="block").collect()} == {"block"}
    assert url_rules.judge_urls(pages.limit(0), none).collect() == []
    both = spark.createDataFrame([("net", "/", "allow"), ("net", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    assert url_rules.judge_urls(pages, both).where(F.col("page_id") == 1).first()["verdict"] == "block"
