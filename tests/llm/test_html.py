import itertools
import random

from pyspark.sql import functions as F

from tokenloom.llm import html


def test_minimum_cut_against_all_labellings():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randrange(1, 8)
        gains = [rng.randrange(-9, 10) for _ in range(n)]
        edges = [(a, b, rng.randrange(0, 8)) for a in range(n) for b in range(a) if rng.random() < 0.6]

        def cost(side):
            own = sum(max(g, 0) if not s else max(-g, 0) for g, s in zip(gains, side))
            return own + sum(c for a, b, c in edges if side[a] != side[b])

        best = min(cost(s) for s in itertools.product((False, True), repeat=n))
        assert cost(html.minimum_cut(gains, edges)) == best


def text(page, weights=None):
    return html.main_text(page, weights or {})


def test_pages():
    body = "A long enough sentence of the article, with a comma. "
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
      <nav><ul><li><a href="/a>b">Menu</a></li></ul></nav><!-- ad > --><div class="ad">Buy now.</div>
      <header><h2>Site</h2></header><article><h1>Head &amp; more&nbsp;&#33;</h1><p><b>{body}<br><p>Second
      line &lt;tag&gt;</p><aside>Aside.</aside><form><input><button>Go</button></form><div class="reader-comments"><p>{body}</p></div>
      <table><tr><td>cell</td></tr></table></article><div id="cookieNotice">We use cookies.</div><footer>&copy; x</footer></body></html>"""
    assert text(page) == f"Head & more !\n{body.strip()}\nSecond line <tag>\ncell"
    for cut in range(len(page)):
        text(page[:cut])                                       # any truncation is read
    assert text("<article><p>one<p>two</article") == "one\ntwo"
    assert text("<article><p>one &am") == "one &am"
    assert text("<article><p>a < b and c > d</p><p>x<!-- gone") == "a < b and c > d\nx"
    assert text("<article>x<script>if (a < b) { '<p>' }") == "x"
    assert text("</div></p><article>a</b></i>b</article>") == "ab"
    assert text(None) == text("") == text("<p></p>") == ""
    assert len(text("<article>" + "<li>item" * 20_000 + "</article>")) > 90_000
    assert text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_soup_without_article_elements():
    """The shape of the blocks and their neighbours decide where no element says what it is."""
    counts = html.Counter()
    long = "The council met on Tuesday, as it does, and decided nothing of note about the old bridge. "
    for i in range(40):
        html.count_shapes(f"<nav><a>Home</a><p><a>News {i}</a></p></nav><article><p>{long * (1 + i % 4)}</p><p>{long}</p></article>", counts)
    weights = html.weights_of(counts)
    page = f"<div><p><a>Home</a></p><p><a>News</a></p></div><div><p>{long * 3}</p><p>Indeed.</p><p>{long * 2}</p></div><div><p><a>Next</a></p></div>"
    assert text(page, weights) == f"{(long * 3).strip()}\nIndeed.\n{(long * 2).strip()}"


def test_extracted(spark):
    rows = [(1, "u", "<nav>m</nav><article><p>one</p></article>"), (2, None, None), (None, "u", ""), (1, "u", "<article>" + "x " * 500_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit(1), "digest": F.lit("x")})
    found = sorted(((r["_id"], r["url"], r["n_chars"]) for r in html.extracted(spark, pages).collect()), key=repr)
    assert found == sorted([(1, "u", 3), (2, None, 0), (None, "u", 0), (1, "u", 999_999)], key=repr)
    assert html.extracted(spark, pages.limit(0)).collect() == []


def test_wrapper_names():
    """A class or id word of a wrapper does not take the article with it."""
    long = "The council met on Tuesday, as it does, and decided nothing of note about the old bridge. "
    around = "<nav><a>Home</a></nav>{}<aside><p>Aside.</p></aside><footer>x</footer>"
    inner = f"<p>{long}</p><p>{long * 2}</p>"
    want = f"{long.strip()}\n{(long * 2).strip()}"
    for names in ("class='page has-sidebar'", "class='layout no-sidebar'", "class='content with-header'", "id='nav-wrapper'", "id=hasSidebar"):
        for article in ("<article>{}</article>", "<main>{}</main>", "<div role=main>{}</div>", "<section><main class=search>{}</main></section>"):
            assert text(f"<body><div {names}>{around.format(article.format(inner))}</div>") == want, (names, article)
    # Without article elements the shape of the blocks outweighs a word, and so do their neighbours.
    counts = html.Counter()
    for i in range(40):
        html.count_shapes(f"<nav><a>Home</a><p><a>News {i}</a></p></nav><article><p>{long * (1 + i % 4)}</p><p>{long}</p></article>", counts)
    assert text(f"<body><nav><a>Home</a></nav><div id=nav-wrapper>{inner}</div>", html.weights_of(counts)) == want
    # Evidence that is an element's own stays, and so do comments in an article.
    assert text(f"<body><aside><article><p>{long}</p></article></aside>") == ""
    assert text(f"<article><p>{long}</p><div class=comments><article><p>No.</p></article></div></article>") == long.strip()
    assert text("<div class=comments><article class=comment><p>No.</p></article></div>") == ""


def test_cut_outweighs_elements():
    """Between two paragraphs of an article a block of links is no reason to keep it: neighbours and shape decide together."""
    assert max(html.PLAIN, html.OUTSIDE) < html.CLIP + 3 * html.NEAR and html.WORD < html.CLIP
    weights = {"links4": -9.0, "tag p": 1.0, "links0": 4.0}
    page = f"<article><p>{'Some words here. ' * 9}</p></article>" + "<aside><p><a>More</a></p></aside>"
    assert text(page, weights) == ("Some words here. " * 9).strip()
    block = html.blocks("<aside>x y z</aside>")[0]
    gains = round(html.SCALE * (block.element.evidence + html.CLIP))
    assert html.minimum_cut([200, gains, 200], [(0, 1, 32), (1, 2, 32)]) == [True, True, True]


def test_attributes_are_read_by_name():
    """A word within another name or a value says nothing."""
    body = "<p>The council met on Tuesday, as it does, and decided nothing.</p>"
    want = "The council met on Tuesday, as it does, and decided nothing."
    for page in ("<div style=\"overflow:hidden\"><article>{}</article></div>", "<article style='overflow: hidden'>{}</article>",
                 "<article data-hidden='false'>{}</article>", "<article title='the hidden life'>{}</article>",
                 "<div data-role='navigation'><article>{}</article></div>", "<article data-class=sidebar id2=nav>{}</article>",
                 "<article title=\"class='ad' hidden\">{}</article>", "<article aria-hidden=false>{}</article>",
                 "<article class=story class=hidden-ad>{}</article>", "<article data-x = 'a'class='story'>{}</article>"):
        assert text(page.format(body)) == want, page
    for page in ("<article hidden>{}</article>", "<article hidden=''>{}</article>", "<article HIDDEN='until-found'>{}</article>",
                 "<article aria-hidden = \"TRUE\">{}</article>", "<div title='x' hidden id=a><article>{}</article></div>",
                 "<div role='navigation'>{}</div>"):
        assert text(page.format(body)) == "", page


def test_pages_without_labelled_elements(spark):
    """Nothing is learned where no element says what it is; shape and neighbours still find the text."""
    long = "The council met on Tuesday, as it does, and decided nothing of note about the old bridge. "
    page = f"<div><p><a>Home</a></p><p><a>News</a></p></div><div><h1>Bridge stays</h1><p>{long * 3}</p><p>Indeed.</p><p>{long * 2}</p></div><div><p><a>Next</a></p></div>"
    want = f"Bridge stays\n{(long * 3).strip()}\nIndeed.\n{(long * 2).strip()}"
    pages = spark.createDataFrame([(i, "u", page) for i in range(5)], "page_id bigint, url string, html string")
    assert {r["text"] for r in html.extracted(spark, pages).collect()} == {want}


def test_end_tags_without_a_start_take_no_time():
    import time
    start = time.perf_counter()
    assert text("<article>" + "<div>" * 8000 + "</section>" * 8000 + "x") == "x"
    assert time.perf_counter() - start < 0.5
