"""Page extraction and approximate nearest neighbours."""

import time

import numpy as np
import pytest

from nearfield.llm import ann, html_main
from nearfield.llm.common import table
from nearfield.llm.queries import ORACLES, QUERIES

PAGE = "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><a>Home</a></nav><div class='cookie-notice'>We use cookies</div>%s<aside>More</aside><form>Mail <input></form><footer>&copy; x</footer></body></html>"


def lines(text):
    return [x for _, x in html_main.page_lines(text)]


def test_zones():
    assert lines(PAGE % "<article><h1>A &amp; B</h1><p>one\n  two<p>three<div class=ad>buy</div><div class='comments'>me too</div></article>") == ["A & B", "one two", "three"]
    assert lines("<p>cut &am") == ["cut &am"] and lines("<p>x</p><di") == ["x"] and lines(None) == [] and lines("a <b>bold</b>, <i>b</i>") == ["a bold, b"]
    assert lines("<article><p>x<!-- <p>no</p> -->y &#233;&nbsp;z</p></article><!-- open") == ["xy é z"]


def test_article_keeps_what_only_sounds_like_a_template():
    kept = "<div class='related-work'>one</div><p class='side-effects'>two</p><div class='alert'>three</div><p>four <math><mi>x</mi></math></p><section class='menu-planning search'>five</section>"
    assert lines(f"<article>{kept}<div class='x ad-slot'>no</div><ul class='comment-list'><li>no</ul><div id='newsletter_form'>no</div></article>") == ["one", "two", "three", "four x", "five"]
    assert lines("<div class='alert'>no</div><div class='related links'>no</div><div class='alerting'>yes</div>") == ["yes"]


def test_elements_are_hidden_by_their_own_attributes_alone():
    for tag in ("<article class='overflow-hidden'>", "<p style='overflow:hidden'>", "<p title='a hidden place'>", "<p data-state='hidden'>", "<p hidden=until-found>", "<p aria-hidden=false>", "<p data-style='display:none'>", "<p style='x-display:none'>"):
        assert lines(f"<body class='overflow-hidden'>{tag}text</body>") == ["text"], tag
    for tag in ("<p hidden>", "<p class=x HIDDEN=''>", "<p aria-hidden='true'>", "<p style='color:red; display : none'>", "<p/hidden>"):
        assert lines(f"<body hidden style='display:none'><div>text</div>{tag}no</p></body>") == ["text"], tag


def test_quotes_in_tags():
    assert lines('<p><a title="x>two</a> three') == ["two three"]
    assert lines('<p><a title="x>two</a> three <b class="y">four</b>') == ["two three four"]
    assert lines("<p><a title='a > b' href=x>two</a> it's</p><p>don't") == ["two it's", "don't"]
    assert lines('<p><a onclick="if (a<b) c(\'>\')">two</a>') == ["two"]
    assert lines("<p it's>one</p><p \"odd>two</p>") == ["one", "two"]
    assert lines('<p class="x') == [] and lines("<p>one</p><p class='") == ["one"]
    assert html_main.attributes(""" A=1 b = 'two' C="x > y" a=3 d""") == {"a": "1", "b": "two", "c": "x > y", "d": ""}


@pytest.mark.parametrize("page", ["<span>" * 100_000 + "</b>" * 100_000 + "x", "<div>" * 100_000 + "x" + "</div>" * 100_000, "<a title=\">x" * 100_000, "<a b='" * 100_000 + "<p>x", "<p" * 100_000 + ">x", "<!--" * 100_000])
def test_time_grows_with_the_page_alone(page):
    began = time.process_time()
    html_main.page_lines(page)
    assert time.process_time() - began < 2


def test_common_lines_is_a_longest_common_subsequence():
    rng = np.random.default_rng(2)
    for n in range(200):
        a, b = (rng.choice(list("abcde"), rng.integers(0, 9 + n // 8)).tolist() for _ in range(2))
        length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                length[i + 1][j + 1] = length[i][j] + 1 if x == y else max(length[i][j + 1], length[i + 1][j])
        held = html_main.common_lines(a, b)
        assert len(held) == length[-1][-1]
        rest = iter(b)
        assert all(a[k] in rest for k in sorted(held))


def brute_pages(pages):
    """Every page against the neighbour in order whose path shares the longer prefix, over one sorted list."""
    import re

    def key(r):
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", r[1] or "")
        return (m[1].lower(), m[2]) if m else ("", "")

    order = sorted(pages, key=lambda r: (*key(r), r[1] is not None, r[1] or "", r[0]))
    out = {}
    for k, r in enumerate(order):
        near = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order) and key(order[j])[0] == key(r)[0]]
        prefix = lambda other: html_main._prefix(key(other)[1], key(r)[1])
        mate = max(near, key=prefix, default=None)
        out[r[0]] = html_main.main_text(html_main.page_lines(r[2]), mate and html_main.page_lines(mate[2]))
    return out


def test_differencing_over_range_edges(spark):
    """Pages without an article, one host with most of them, more ranges than some have pages: the mate decides most texts."""
    rng = np.random.default_rng(12)
    pages = []
    for i in range(400):
        host = "big.example" if i % 4 else f"h{i % 7}.example"
        section = int(rng.integers(0, 6))
        lines = [f"Site {host}", f"Section {section}", *[f"Own line {i} {k}" for k in range(int(rng.integers(1, 5)))], f"Teaser {int(rng.integers(0, 3))}", "All rights reserved"]
        url = None if i % 50 == 3 else f"http://{host}/s{section}/{int(rng.integers(0, 10**6))}"
        pages.append((i, url, "".join(f"<p>{x}</p>" for x in lines)))
    want = brute_pages(pages)
    alone = {i: html_main.main_text(html_main.page_lines(h), None) for i, _, h in pages}
    got = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == want
    assert sum(got[i] != alone[i] for i in got) > 380


def test_open_lines_are_differenced(spark):
    """Without an article element, lines shared with the nearest page go."""
    body = "<div>Site name</div><p>%s</p><p>All rights reserved</p>"
    pages = [(1, "http://h/a/1", body % "first"), (2, "http://h/a/2", body % "second"), (3, "http://other/x", body % "third"), (4, None, None), (5, "http://h/b/9", PAGE % "<article><p>own</p></article>")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_main.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == ("first", 5) and got[2] == ("second", 6)
    assert got[3][0] == "Site name\n\nthird\n\nAll rights reserved"
    assert got[4] == ("", 0) and got[5] == ("own", 3)
    assert html_main.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_open_lines_beside_an_article_are_differenced(spark):
    """A headline beside the article stays, a line that the nearest page shares goes, on pages with an article too."""
    body = "<div>Site name</div><h1>%s</h1><article><p>%s</p></article><p>All rights reserved</p>"
    pages = [(1, "http://h/a/1", body % ("Head one", "same")), (2, "http://h/a/2", body % ("Head two", "same")), (3, "http://other/x", body % ("Head three", "third"))]
    got = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == "Head one\n\nsame" and got[2] == "Head two\n\nsame"
    assert got[3] == "Site name\n\nHead three\n\nthird\n\nAll rights reserved"


def test_pages_of_the_table(spark, sf_dir):
    """The article's blocks by a plain cut of this template."""
    import html
    import re

    for r in QUERIES["op3_html_main"](spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)
        blocks = re.split(r"</?(?:h1|p)>", re.sub(r"<[^>]*$", "", inner[1]) if inner else "")
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks]
        assert r.text == "\n\n".join(x for x in want if x)
        assert r.n_chars == len(r.text)


def test_chi_square():
    assert ann.chi_square_cdf(15.507, 8) == pytest.approx(0.95, abs=1e-4)
    assert ann.chi_square_cdf(0.0) == 0.0


def brute(vectors, asked, k):
    out = {}
    for q in asked:
        v = np.array(vectors[q], np.float64)
        scores = [(-ann.exact_cosine(v, np.array(w, np.float64)), i) for i, w in vectors.items() if i != q]
        out[q] = sorted(scores)[:k]
    return out


def test_recall_and_ties(spark):
    rng = np.random.default_rng(8)
    vectors = {i: rng.standard_normal(24).astype(np.float32).tolist() for i in range(3000)}
    for i in range(0, 3000, 3):
        vectors[i] = vectors[0]  # a third of all rows is one vector
    rows = [(i, v) for i, v in vectors.items()] + [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [None] + [1.0] * 23), (None, vectors[1]), (5004, []), (5005, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = [i for i in range(0, 3000, 50)]
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    want = brute(vectors, asked, 5)
    assert set(got) == set(want)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.98 * 5 * len(want)
    assert got[0] == want[0] and [i for _, i in got[0]] == [3, 6, 9, 12, 15]


def test_recall_over_cells_parts_and_blocks(spark, monkeypatch):
    """Many cells, a cell of a third of all rows that is cut into parts, several blocks of queries; clustered rows visit few cells."""
    monkeypatch.setattr(ann, "SHARD_ROWS", 200)
    monkeypatch.setattr(ann, "QUERY_ROWS", 32)
    rng = np.random.default_rng(21)
    centers = rng.standard_normal((60, 32))
    rows = [(i, ((centers[i % 60] if i % 5 else 0) + (0.05 if i % 5 else 1) * rng.standard_normal(32)).astype(np.float32).tolist()) for i in range(4000)]
    rows += [(i, rows[7][1]) for i in range(4000, 6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    raw = np.array([v for _, v in rows], np.float64)
    unit = raw / np.linalg.norm(raw, axis=1)[:, None]
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 25 = 0"), 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert len(got) == 240 and all(sorted(x) == [1, 2, 3, 4, 5] for x in got.values())
    hits = 0
    for q, found in got.items():
        score = unit @ unit[q]
        score[q] = -2
        kth = np.sort(score)[-5]
        hits += sum(s >= kth - 1e-9 for _, s in found.values())
        assert all(abs(score[i] - s) < 1e-9 for i, s in found.values())
    assert hits >= 0.98 * 5 * len(got)


def test_nearest_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(df, df.where("vec_id = 0"), 5).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 1, 0.0)]
    assert ann.nearest(df.where("false"), df, 5).count() == 0 and ann.nearest(df, df.where("false"), 5).count() == 0


@pytest.mark.parametrize("case", ["twice", "eight times", "table twice", "own id nine times", "several vectors"])
def test_repeated_rows_take_no_places(spark, case):
    rng = np.random.default_rng(9)
    vectors = {i: rng.standard_normal(8).astype(np.float32).tolist() for i in range(41)}
    rows = list(vectors.items())
    query = vectors[0]
    if case == "own id nine times":
        rows = [(0, query)] * 9 + [(1, query), (2, query)]
    elif case == "several vectors":
        rows += [(7, [float(x) + 0.001 * j for x in query]) for j in range(9)]  # one id, nine vectors by the query
    else:
        near = min(range(1, 41), key=lambda i: -ann.exact_cosine(np.array(query), np.array(vectors[i])))
        rows += {"twice": [(near, vectors[near])], "eight times": [(near, vectors[near])] * 7, "table twice": rows}[case]
    scores = {}
    for i, v in rows:
        if i:
            s = ann.exact_cosine(np.array(query, np.float64), np.array(np.array(v, np.float32), np.float64))
            scores[i] = max(scores.get(i, -2.0), s)
    want = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.vec_id, r.score) for r in ann.nearest(df, df.where("vec_id = 0"), 5).orderBy("rank").collect()]
    assert got == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    mine = sorted(repr([r[c] for c in cols]) for r in df.collect())
    assert mine == sorted(repr([r[want.columns.index(c)] for c in cols]) for r in want.fetchall())
