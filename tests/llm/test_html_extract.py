import html
import json
import os
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.llm import html_extract as H


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_longest_common_subsequence(a, b):
    pairs = H.common(list(a), list(b))
    assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(set(pairs))
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert len(pairs) == lcs(a, b)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=40), st.text("abc", max_size=40))
def test_longest_common_subsequence_of_repeated_lines(a, b):
    most, H.MATCHES = H.MATCHES, 4
    try:
        pairs = H.common(list(a), list(b))
    finally:
        H.MATCHES = most
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert len(pairs) == lcs(a, b)


def test_long_pages_of_few_lines():
    assert len(H.common(["x", "y"] * 1001, ["y", "x"] * 1001)) == 2001
    a = [k % 7 if k % 3 else k % 50_000 for k in range(40_000)]
    pairs = H.common(a, a[:20_000] + [-1] + a[20_001:])
    assert len(pairs) == len(a) - 1


def text(page, other=None):
    return H.main_text(H.lines_of(page), H.lines_of(other) if other is not None else None)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p><b>One
 two&nbsp;three<br>four<p>Five <a href="x>y">six</a><div class="ad">Buy</div><p>Seven<aside>Side</aside><form><input>Mail</form><section id=comments><p>First!</section></article><footer>&copy; me</footer>"""


def test_article_alone_is_left():
    assert text(PAGE) == "Head & line\n\nOne two three four\n\nFive six\n\nSeven"


def test_odd_pages():
    assert text(None) == text("") == text("<p") == "" and text("<") == "<"
    assert text("plain & text") == "plain & text"
    assert text("<p>a<p>b") == "a\n\nb"
    assert text("<article><p title=\"un'closed>x</p></article> 1 < 2") != ""
    assert text("<article>" * 3000 + "deep") == "deep"
    assert text("<article><header><h2>Name</h2><p>by me</p></header>x</article>") == "Name\n\nx"


def test_shared_lines_go_where_markup_says_nothing():
    page = lambda own: f"<body><div>Welcome to the site</div><p>{own}</p><p>{own} more text of this page alone</p><div>All about us</div>"
    assert text(page("one")) == "Welcome to the site\n\none\n\none more text of this page alone\n\nAll about us"
    assert text(page("one"), page("two")) == "one\n\none more text of this page alone"
    assert text(page("one"), page("one")) == text(page("one"))  # copies tell nothing apart
    article = "<article><p>shared</p><p>{}</p></article>"
    assert text(article.format("a"), article.format("b")) == "shared\n\na"


def test_lines_of_an_article_that_a_neighbour_shares_go():
    page = lambda own: f"<main><p>Share this story</p><p>{own}</p><div>By the desk of the paper</div></main>"
    assert text(page("one story that stands on this page alone and is long"), page("two")) == "one story that stands on this page alone and is long"
    named = "<article><h1>A headline</h1><p>Body of the first page</p></article>"
    assert text(named, "<article><p>Another body</p></article><aside>A headline</aside>") == "A headline\n\nBody of the first page"
    assert text(named, named) == text(named)


def test_only_pages_without_text_of_their_own_are_copies():
    page = lambda own: f"<div>{'menu ' * 120}</div><p>{own}</p>"
    own = "what this page alone says, of some hundred characters in all, which is a small part of the page it is on"
    assert text(page(own), page(own[::-1])) == own
    assert text(page(own + " and more" * 500), page("stub")) == own + " and more" * 500
    assert text(page("1"), page("2")) == text(page("1"))


def test_copies_are_paired_past_each_other(spark, monkeypatch):
    page = lambda own: f"<body><div>Frame of the site</div><p>{own} and some more text that only this page has</p>"
    rows = [(k, f"http://a.org/x/1?copy={k}", page("one")) for k in range(300)] + [(300, "http://a.org/x/2", page("two"))]
    rows += [(400 + k, f"http://b.org/{k}", page("one")) for k in range(3)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.text for r in H.extract(d).collect()}
    assert {got[k] for k in range(300)} == {"one and some more text that only this page has"} and got[300].startswith("two")
    assert {got[k] for k in range(400, 403)} == {text(page("one"))}  # nothing but copies
    monkeypatch.setattr(H, "HELD", 100)
    run = H._Run(H._Page(0, "", "", "/", H._PACK.compress(b"[]")), None, None)
    for k in range(1, 9):
        run.add(H._Page(k, "", "", "/", H._PACK.compress(b'[[1, "%d"]]' % k)))
    assert run._file and [(p.page_id, p.lines) for p in run.pages()] == [(0, [])] + [(k, [[1, str(k)]]) for k in range(1, 9)]


def test_pages_pair_within_their_host(spark):
    page = lambda own, frame: f"<body><div>{frame}</div><p>{own} and some more text that only this page has</p>"
    rows = [(1, "http://a.org/x/1", page("one", "Frame A")), (2, "http://a.org/x/2", page("two", "Frame A")), (3, "http://b.org/x/1", page("three", "Frame A")), (4, None, None), (4, None, None), (5, "http://a.org/y", "<p>" + "long " * 200_000)]
    d = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, text string, host string").coalesce(1)
    got = sorted((r.page_id, r.text, r.n_chars) for r in H.extract(d).collect())
    assert [g[0] for g in got] == [1, 2, 3, 4, 4, 5]
    assert got[2][1].startswith("Frame A") and got[3][1] == "" and got[5][2] == 200_000 * 5 - 1
    assert all(g[2] == len(g[1]) for g in got)
    assert H.extract(d.limit(0)).count() == 0


def test_ranges_do_not_change_the_result(spark):
    page = lambda k: f"<body><div>Frame {k // 50}</div><p>{'same text of copies' if k % 10 in (3, 4, 5) else f'{k} text that only the page of number {k} has'}</p><div>Foot {k // 7}</div>"
    rows = [(k // 2 if k < 20 else k, f"http://{'abc'[k % 3 if k > 90 else k // 50]}.org/{k // 9}/x", page(k)) for k in range(120)] + [(7, None, page(7))] * 2
    d = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as they are, tasks stay apart
    got = []
    try:
        for parts in (1, 8, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got.append(sorted(map(tuple, H.extract(d).collect()), key=str))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got[0]) == len(rows) and got[0] == got[1] == got[2]


def split(url):
    rest = url.split("://", 1)[1] if "://" in (url or "") else ""
    head = re.match("[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in head), re.match("[^?#]*", rest[len(head) :])[0]


def plainly(rows):
    """page_id and text of every page: the sorted table walked in one piece, each page against all of its host that is outside its run."""
    found = [(*split(url), page_id, url or "", H.lines_of(page)) for page_id, url, page in rows]
    found.sort(key=lambda r: (r[0], r[1], r[2], r[3], H._PACK.compress(json.dumps(r[4], ensure_ascii=False).encode())))
    alike = lambda a, b: H.copies(a[4], b[4], H.shared(a[4], b[4]))
    run = [0]
    for a, b in zip(found, found[1:], strict=False):
        run.append(run[-1] + (a[0] != b[0] or not alike(a, b)))
    out = []
    for k, page in enumerate(found):
        prefix = lambda other: len(os.path.commonprefix([page[1], other[1]]))  # noqa: B023, E731
        before = [o for o, r in zip(found, run, strict=False) if o[0] == page[0] and r == run[k] - 1][-1:]
        after = [o for o, r in zip(found, run, strict=False) if o[0] == page[0] and r == run[k] + 1][:1]
        near = sorted(before + after, key=lambda o: -prefix(o))
        other = next((o for o in near if not alike(page, o)), None)
        # of two alignments that are equally long the one counts that the page before begins
        pairs = [(j, i) for i, j in H.shared(other[4], page[4])] if other in before else H.shared(page[4], other[4]) if other else []
        out.append((page[2], H.left_over(page[4], other[4] if other else [], pairs)))
    return sorted(out)


def test_equals_a_walk_over_the_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in pages.collect()]
    frame = lambda k: f"<body><div>Frame {k // 40}</div><p>{'the same' if k % 9 in (2, 3) else f'{k} has a text of its own that is long'}</p><div>Foot {k // 6}</div>"
    rows += [(10_000 + k, f"http://{'XyZ'[k % 3]}.org/{k // 12}/p{k % 4}?q={k}", frame(k)) for k in range(150)]
    got = sorted((r.page_id, r.text) for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want = plainly(rows)
    assert [g for g, w in zip(got, want, strict=True) if g != w] == []


def test_neighbours_decide_texts_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    alone = pages.withColumn("url", F.concat(F.lit("http://h"), F.col("page_id").cast("string"), F.lit(".org/")))
    one, two = ({r.page_id: r.text for r in H.extract(d).collect()} for d in (pages, alone))
    assert sum(one[k] != two[k] for k in one) >= 100 and all(len(one[k]) <= len(two[k]) for k in one)


def test_words_that_name_an_articles_own_parts():
    page = "<article><p>One</p><div class='share alert'><p>Two <math><mi>x</mi></math></p></div><object>three</object><div class='newsletter'>Buy</div></article><div class='share'>Post it</div>"
    assert text(page) == "One\n\nTwo x\n\nthree"
    assert text("<div class='share'>Post it</div><p>Own text</p>") == "Own text"


def test_articles_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    for r in pages.collect():
        article = re.sub("</?(?:b|br)>", " ", re.search("<article>(.*)</article>", r.html, re.S)[1])
        blocks = [" ".join(html.unescape(x).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n\n".join(x for x in blocks if x)
