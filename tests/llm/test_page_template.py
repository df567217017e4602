import random
from os.path import commonprefix

import pytest

from loghaven.llm import html_blocks as H
from loghaven.llm import page_diff
from loghaven.llm.common import table


def keys(html):
    return [p.key for p in H.pieces(list(H.blocks(html)))]


def text(html, near):
    page = H.pieces(list(H.blocks(html)))
    gone = H.deleted_pieces([p.key for p in page], keys(near) if near is not None else None)
    return "\n".join(x for i, p in enumerate(page) if i not in gone for x in p.texts)


MENU = "<nav><ul><li>a<li>b</ul></nav>"
FOOT = '<div id="footer-7">f</div>'


@pytest.mark.parametrize(
    ("html", "near", "want", "without"),
    [
        # menus of other words and length, a footer with another number: template by their slots
        (MENU + "<article>x</article>" + FOOT, "<nav>c</nav><article>y</article><div id=footer-8>g</div>", "x", "a\nb\nx\nf"),
        # an advert that the nearest page lacks goes by mark-up, whatever differencing does
        (MENU + "<div class=ad>buy</div><article>x</article>", MENU + "<article>y</article>", "x", "a\nb\nx"),
        # a footer in another place
        (FOOT + MENU + "<article>x</article>", MENU + "<article>y</article>" + FOOT, "x", "f\na\nb\nx"),
        # articles share lines
        (MENU + "<article><p>same<p>x</article>", MENU + "<article><p>same<p>y</article>", "same\nx", "a\nb\nsame\nx"),
        # no article region: shared lines go, unless all of them are shared
        (MENU + "<p>top<p>x<p>end", MENU + "<p>top<p>y<p>end", "x", "a\nb\ntop\nx\nend"),
        (MENU + "<p>top<p>end", MENU + "<p>top<p>y<p>end", "top\nend", "a\nb\ntop\nend"),
        # no pair
        (MENU + "<article>x</article>z" + FOOT, None, "x", "x"),
    ],
)
def test_deleted_pieces(monkeypatch, html, near, want, without):
    assert text(html, near) == want
    monkeypatch.setattr(H, "template_pieces", lambda mine, near: set())
    assert text(html, near) == without


def test_differencing_decides_the_given_pages(spark, monkeypatch):
    """The nearest page by brute force: the same texts, and other ones where differencing deletes nothing."""
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    got = {r["page_id"]: r["text"] for r in page_diff.extract(pages).collect()}
    rows = [(r["page_id"], r["host"], r["path"], r["html"] or "") for r in pages.select("page_id", "html", page_diff.host_of(page_diff.F.col("url")).alias("host"), page_diff.path_of(page_diff.F.col("url")).alias("path")).collect()]
    near = {i: max((b for b in rows if b[0] != i and b[1] == host and keys(b[3]) != keys(html)), key=lambda b: len(commonprefix([b[2], path])), default=None) for i, host, path, html in rows}  # noqa: B023
    found = {i: text(html, near[i] and near[i][3]) for i, _, _, html in rows}
    assert found == got and all(got.values())
    monkeypatch.setattr(H, "template_pieces", lambda mine, near: set())
    assert sum(text(html, near[i] and near[i][3]) != got[i] for i, _, _, html in rows) > len(rows) // 2


@pytest.mark.parametrize("parts", [1, 7])
def test_sites_against_brute_force(spark, parts):
    """Pages with and without article region, copies under other menus, boilerplate that comes and goes."""
    rng = random.Random(11)
    rows, lines, marked = [], {}, {}
    for i in range(120):
        host = rng.choice(["a", "b", "c"])
        mine = sorted(rng.sample(range(8), rng.randint(0, 4))) + [100 + (i if rng.random() < 0.8 else 0)]
        marked[i] = rng.random() < 0.4
        inner = "".join(f"<p>line {n}</p>" for n in mine)
        menu = "<nav>" + "<li>item" * rng.randint(1, 4) + "</nav>" if rng.random() < 0.8 else ""
        ad = f"<div class='ad n{i}'>buy {i}</div>" if rng.random() < 0.5 else ""
        for copy in range(rng.choice([1, 1, 3])):
            other = "<aside>more</aside>" * rng.randint(0, 2)
            rows.append((1000 * copy + i, f"http://{host}.example/{rng.randrange(10**6):06d}", menu + ad + (f"<article>{inner}</article>" if marked[i] else inner) + other + f"<footer>{i} {copy}</footer>"))
            lines[1000 * copy + i] = (host, tuple(mine))
    entries: dict = {}
    for i, url, _ in rows:
        host, mine = lines[i]
        entries.setdefault(host, {}).setdefault(mine, []).append(url)
    want = {}
    for i, _, _ in rows:
        host, mine = lines[i]
        order = sorted((min(urls), m) for m, urls in entries[host].items())
        at = next(j for j, e in enumerate(order) if e[1] == mine)
        beside = [order[j] for j in (at - 1, at + 1) if 0 <= j < len(order)]
        pair = max(beside, key=lambda e: len(commonprefix([e[0], order[at][0]])))[1]
        own = [n for n in mine if n not in pair]
        want[i] = "\n".join(f"line {n}" for n in (mine if marked[i % 1000] or not own else own))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["page_id"]: r["text"] for r in page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want


def test_odd_texts_come_back_whole(spark):
    """Lone surrogates cannot be in a column; everything else passes the compressed join as it is."""
    odd = ["", "é 漢字 🙂 \x00 �", "x" * 300_000, "<article>" + "<p>a &amp; b" * 3000]
    rows = [(i, "http://o.example/", t) for i, t in enumerate(odd)] + [(None, None, "<p>n"), (None, None, "<p>n"), (9, "http://o.example/", None)]
    got = sorted((r["page_id"] is None, r["page_id"] or 0, r["text"]) for r in page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(False, 0, ""), (False, 1, "é 漢字 🙂 \x00 �"), (False, 2, "x" * 300_000), (False, 3, "\n".join(["a & b"] * 3000)), (False, 9, ""), (True, 0, "n"), (True, 0, "n")]
