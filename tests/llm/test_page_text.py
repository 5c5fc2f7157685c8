"""Main text of pages: templates of a host, tag soup, and whole tables against a plain reading of the article."""

import html
import itertools
import random
import re

import pytest

from curbledger.llm import page_text as P

SCHEMA = "page_id long, url string, html string"


def lines(source):
    page = P.read_page(source)
    return [t for t, z in zip(page.texts, page.zones) if z != P.SIDE]


def of_article(source):
    found = re.search(r"<article[^>]*>(.*?)(?:</article>|\Z)", source, re.S)
    pieces = re.split(r"</?(?:p|h1|br|ul|li|div)\b[^>]*>", found[1]) if found else []
    clean = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in pieces]
    return "\n".join(x for x in clean if x)


@pytest.mark.parametrize("source, want", [
    (None, []), ("", []), ("   ", []), ("just text", ["just text"]), ("a &amp; b &lt;p&gt; &#233;&#x41; &nbsp;x&copy", ["a & b <p> éA x©"]),
    ("<p>one<p>two", ["one", "two"]), ("<p><b>one<br><p>two</p>", ["one", "two"]), ("<p>a<b>b</b>c\n\t d<p>", ["abc d"]),
    ("1 < 2 <3 <p>x", ["1 < 2 <3", "x"]), ("<p>x<!-- <p>no</p> --></p><!-- open <p>no", ["x"]), ("<p>a</p><p tit", ["a"]), ("<p>a</p", ["a"]),
    ("<script>var t='</p>';</script><style>p{}</style><title>no</title><p>yes", ["yes"]), ("<script>never ends <p>no", []),
    ('<p title="a>b" data-x=\'<i>\'>q</p>', ["q"]), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><th>c</table>", ["a", "b", "c"]), ("<dl><dt>t<dd>d<dt>u</dl>", ["t", "d", "u"]), ("<![CDATA[no]]><?no?>yes", ["yes"]),
    ("<svg><text>no</text></svg><button>no</button><select><option>no<option>no</select><p>yes", ["yes"]),
    ("<p hidden>no</p><p style='display: none'>no<p aria-hidden=true>no</p><p>yes", ["yes"]), ("<p>x <span class=ad>no</span> y</p>", ["x y"]),
])
def test_lines_of_a_page(source, want):
    assert lines(source) == want


def test_side_matter_in_and_around_the_article():
    source = """<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li>Home</ul></nav><div id="cookie-notice">We use cookies</div>
    <div class="ad">Buy</div><div class="wrap main menu"><article class="post"><header class="header"><h1>Title &amp; more</h1><p>By someone</p></header>
    <p>First.</p><aside>Aside</aside><div class="share">Share this</div><figure><figcaption>Seen here</figcaption></figure>
    <blockquote>Quoted</blockquote><form><label>Mail</label><input></form><section id="comments"><article class="comment"><p>I disagree at such length that this
    text is longer than anything else on the whole page, which must not make it the article.</p></article></section><footer>Tags</footer></article></div>
    <aside><article><p>Teaser</p></article></aside><section class="comments"><p>First!</p></section><footer>&copy; Site</footer>"""
    assert lines(source) == ["Title & more", "By someone", "First.", "Seen here", "Quoted"]


def test_containers_that_hold_the_page():
    assert lines("<form><div class='popup'><p>x</p><main><p>all of it</p></main></div></form>") == ["all of it"]
    assert lines("<nav><p>never closed<article><p>text</p></article>") == ["text"]
    assert lines("<form><p>a page in a form</p><p>and more of it</p></form><p>rest") == ["a page in a form", "and more of it", "rest"]
    assert lines("<main><h1>T</h1><article><p>a</p></article><div role=navigation>b</div></main><p>c") == ["T", "a"]


def all_common(a, b):
    best = 0
    for k in range(len(a), 0, -1):
        for s in itertools.combinations(a, k):
            it = iter(b)
            if all(x in it for x in s):
                return k
    return best


def test_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = rng.sample(range(9), rng.randint(0, 7)), rng.sample(range(9), rng.randint(0, 7))
        pairs = P.shared(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs) == all_common(a, b)


def site(host, n, rng, body):
    rows = []
    for k in range(n):
        words = lambda m: " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(m))
        rows.append((f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'www.'])}{host}/d/{k}{rng.choice(['', '/', '.html', '?a=1', '#x'])}", *body(words)))
    return rows


def unmarked(words):
    """Nothing in the markup tells the template of this site."""
    own = [words(30) for _ in range(3)]
    top, low = ["Welcome here", "All topics", "All topics"], ["Made by us", "Call us"]
    return "".join(f"<div>{x}</div>" for x in [*top, own[0], own[1], "Good to know", own[2], *low]), "\n".join(own)


def noticed(words):
    """A notice of the site in its own kind of element, and a paragraph that every article quotes."""
    own = [words(30), "A passage that all articles quote.", words(30)]
    return ("<nav>x</nav><article><h1>Same title</h1><p class='disclaimer'>Opinions are ours.</p>" + "".join(f"<p>{x}</p>" for x in own) + "</article>",
            "\n".join(["Same title", *own]))


@pytest.mark.parametrize("near, chunk", [(2, 1000), (2, 4), (1, 7), (3, 6)])
def test_boilerplate_goes_and_quoted_text_stays(spark, near, chunk):
    rng = random.Random(8)
    rows = site("plain.example", 40, rng, unmarked) + site("notice.example", 25, rng, noticed)
    alone = [("http://alone.example/x", "<div>Welcome here</div><div>y</div>", "Welcome here\ny"), (None, "<p>z", "z"), ("no url", "<p>z2", "z2"), ("http://e.example", None, "")]
    copies = [(f"http://copies.example/{k}", "<div>first</div><div>second</div>", "first\nsecond") for k in range(30)]
    everything = [(i, *r) for i, r in enumerate(rows + alone + copies)]
    frame = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h, _ in everything], SCHEMA + ", path string, `row` int").repartition(5)
    got = {r.page_id: "\n".join(r.lines) for r in P.main_texts(frame, near, chunk).collect()}
    assert got == {i: t for i, _, _, t in everything}


def test_chunks_do_not_matter(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(120)
    stripped = pages.withColumn("html", P.F.regexp_replace("html", "</?(article|nav|footer|div)[^>]*>", "<p>"))
    small, large = ({r.page_id: r.lines for r in P.main_texts(stripped, 2, c).collect()} for c in (4, 1000))
    assert small == large
    assert any(len(small[r.page_id]) < len(lines(r.html)) for r in stripped.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_whole_tables(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = P.op12_page_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    ours = sorted(map(tuple, got.collect()))
    assert ours == sorted((r.page_id, r.url, t := of_article(r.html), len(t)) for r in pages.collect())


def test_empty_table_and_repeated_rows(spark):
    assert P.op12_page_text(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "http://a.example/", "<p>x")] * 5 + [(None, None, None)]
    got = P.op12_page_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.text, r.n_chars) for r in got) == [("", 0)] + [("x", 1)] * 5


def test_long_page(spark):
    long = "<article>" + "<p>some words here</p>" * 60_000 + "<p>" + "w" * 2_000_000 + "</article>" + '<a "' * 50_000
    got = P.op12_page_text(spark.createDataFrame([(1, "http://a.example/1", long), (2, "http://a.example/2", long + "<p>x")], SCHEMA)).collect()
    assert {r.n_chars for r in got} == {16 * 60_000 + 2_000_000}
