"""Main text of pages: furniture, template blocks, tree matching and broken markup."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from terrane.llm import wrapper

SCHEMA = "page_id long, url string, html string, row string, host string, shape string, constant string"


def text_of(page):
    return " ".join(t for _, t in wrapper._aligned(page, None, {}, {}))


def test_furniture():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-banner">We use cookies</div>
    <div id="sidebar"><p>Side</p></div><div class="ad">Buy <b>this</b></div><div role="alert">Notice</div><main><article><header><h1>Head &amp; line</h1></header>
    <p>First   <b>bold</b>
    words<i>x</i>.<p>Second &lt;tag&gt; &eacute;<br>third<ul><li>One<li>Two</ul><form><input value="q"><button>Go</button></form>
    <div style="display: none">hidden</div><!-- <p>no</p> --><table><tr><td>a<td>b</table></article>
    <section class="comments"><article class="comment"><p>Reader says</p></article></section></main><aside>Aside</aside><footer>Foot</footer></body></html>"""
    assert text_of(page) == "Head & line First bold wordsx. Second <tag> é third One Two a b"


def test_names_inside_other_attributes_say_nothing():
    assert text_of("""<p>See <a href="/hidden-gems">these</a>, <a href='/x?id=comments'>those</a></p><p title="The hidden valley">Valley</p>
    <section data-overflow="hidden">Section</section><p data-role="menu" data-class=nav>Data</p>""") == "See these, those Valley Section Data"
    assert text_of("""<p hidden>a</p><p title="x"hidden>b</p><p Aria-Hidden=true>c</p><p ROLE='menu'>d</p><p class = "x nav">e</p><p title="class" id=comments>f</p><p>g""") == "g"


def test_pages_without_article():
    assert text_of("<div><p>One</p>two<div class=menu>no</div> three</div>") == "One two three"
    assert text_of("plain text") == "plain text"
    assert text_of("a < b and <b>c") == "a < b and c"
    assert text_of("") == "" and text_of("<p>") == "" and text_of("<!-- open") == ""
    assert text_of("<p>cut off<a href=\"x") == "cut off"


def test_text_inside_a_form_or_a_compound_name():
    assert text_of("<body><nav>Home</nav><form action='/'><p>The page stands in a form.</p><p>All of it.</p><input><button>Go</button></form></body>") == "The page stands in a form. All of it."
    assert text_of("<body><form><div class='page-with-sidebar'><div class='sidebar'>Side</div><p>Main words of the page</p></div></form></body>") == "Main words of the page"
    assert text_of("<div class='content-with-sidebar'><article><p>Main words</p></article></div><div class='related-stories'><p>More</p></div>") == "Main words"
    assert text_of("<div><p>Words enough to be the text of a page</p></div><form><label>Your name please</label></form><div class='cookie-box'>We use cookies</div>") == "Words enough to be the text of a page"
    assert text_of("<article><p>a</p><p class='legal-notice'>b</p><p class='search-engine'>c</p><div class='social-history'>d</div><div class='share-buttons'>e</div><div class='comment-list-2'>f</div></article>") == "a b c d"


def test_a_teaser_is_not_the_article():
    assert text_of("<div><p>The long text of the page stands outside.</p><article>Teaser</article><p>It ends here.</p></div>") == "The long text of the page stands outside. Teaser It ends here."
    assert text_of("<div><article><p>The long text of the page.</p></article><p>More</p></div>") == "The long text of the page."
    assert text_of("<div><p>Outside, long enough to be the page</p><main><p>Main</p></main></div>") == "Main"


def test_deep_and_long():
    assert text_of("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    long = "<article>" + "".join(f"<p>w{k}" for k in range(5000)) + "</article>"
    assert text_of(long) == " ".join(f"w{k}" for k in range(5000))


def brute(a, b):
    """Most pairs by trying all order-keeping assignments of children."""
    if a.tag != b.tag:
        return 0
    best = 0
    for n in range(1, min(len(a.kids), len(b.kids)) + 1):
        for left in combinations(a.kids, n):
            for right in combinations(b.kids, n):
                best = max(best, sum(brute(x, y) for x, y in zip(left, right, strict=True)))
    return 1 + best


def random_tree(rng, depth=3):
    inside = ",".join(random_tree(rng, depth - 1) for _ in range(rng.randint(0, 3))) if depth else ""
    tag = rng.choice("abc")
    return f"{tag}({inside})" if inside else tag


def test_matching_against_brute_force():
    rng = random.Random(8)
    for _ in range(150):
        a, b = wrapper.frame("r(" + random_tree(rng) + ")"), wrapper.frame("r(" + random_tree(rng) + "," + random_tree(rng) + ")")
        want = brute(a, b)
        assert wrapper.matching(a, b, {}) == want
        slots = {}
        wrapper.align(a, b, slots, {})
        assert len(slots) == len(set(slots.values())) <= want


def test_shape_round_trip():
    rng = random.Random(1)
    for _ in range(50):
        shape = "r(" + random_tree(rng) + ")"
        assert wrapper.frame(shape).shape == shape


def page(k, host="a.example", body=None):
    inner = body or f"<p>Story {k} begins here with words {k * 7} and more of them {k * 11}.</p><p>It ends {k} times, and so on until {k * 13} is reached.</p>"
    return (k, f"http://{host}/p/{k}", f"<html><body><div><p>Read all our stories daily</p></div><div>{inner}</div><div><p>Share this story</p></div></body></html>", "r", "h", "s", "c")


def test_template_of_a_host(spark):
    pages = [page(k) for k in range(8)] + [page(100 + k, "small.example") for k in range(2)]
    got = {r.page_id: r.text for r in wrapper.extracted(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got[3] == "Story 3 begins here with words 21 and more of them 33. It ends 3 times, and so on until 39 is reached."
    assert got[100].startswith("Read all our stories daily Story 100")  # two pages say nothing about a template


def test_copies_are_not_a_template(spark):
    same = "<p>One article that was copied many times over the same host, word for word.</p><p>Its second part.</p>"
    pages = [page(k) for k in range(8)] + [page(200 + k, body=same) for k in range(20)]
    got = {r.page_id: r.text for r in wrapper.extracted(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got[205] == "One article that was copied many times over the same host, word for word. Its second part."
    assert "Share" not in got[4]


def test_odd_pages_do_not_spoil_a_host(spark):
    """Empty pages and pages of other layouts on the host; a template longer than the article."""
    legal = "".join(f"<div><p>Paragraph {n} of the terms under which all the pages of this house may be read and used by anybody.</p></div>" for n in range(4))

    def made(k):
        return (k, f"http://o.example/{k}", f"<body><ul><li>Home<li>World<li>Sport</ul><p>Short story {k}.</p>{legal}</body>", *"abcd")

    odd = [(100 + k, f"http://o.example/{100 + k}", [None, "", "<nav>x</nav>", f"<table><tr><td>Table page {k}</table>"][k % 4], *"abcd") for k in range(12)]
    got = {r.page_id: r.text for r in wrapper.extracted(spark.createDataFrame([made(k) for k in range(12)] + odd, SCHEMA)).collect()}
    assert [got[k] for k in range(12)] == [f"Short story {k}." for k in range(12)]
    assert got[100] == "" and got[101] == "" and got[102] == "" and got[103] == "Table page 3"


def test_blocks_that_the_frame_lacks(spark):
    """A notice on most pages of a host is template even if the page that gives the frame has none."""
    pages = [(k, f"http://n.example/{k}", "<body><div><p>Story %d is told here.</p></div>%s</body>" % (k, "" if k % 3 == 0 else "<section><p>Read our terms</p></section>"), *"abcd") for k in range(30)]
    bare = spark.createDataFrame([("n.example", "#page(body(div(p)))")], "host string, shape string")
    keyed = spark.createDataFrame(pages, SCHEMA).select(wrapper.host(F.col("url")).alias("host"), "html")
    assert [len(r.constant) for r in wrapper.templates(keyed, bare).collect()] == [1]
    got = {r.page_id: r.text for r in wrapper.extracted(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got == {k: f"Story {k} is told here." for k in range(30)}


def test_awkward_and_empty(spark):
    pages = spark.createDataFrame([page(1), page(1), (2, None, None, *"abcd"), (3, "no url", "", *"abcd"), (None, "http://a.example", "<p>x", *"abcd"),
                                   (4, "http://b.example/", "<p>" + "word " * 100_000, *"abcd")], SCHEMA)
    out = wrapper.extracted(pages)
    assert out.columns == [*pages.columns, "text"]
    got = [(r.page_id, r.text) for r in out.collect()]
    assert sorted(t for i, t in got if i == 1)[0] == sorted(t for i, t in got if i == 1)[1]
    rest = dict((i, t) for i, t in got if i != 1)
    assert rest[2] == "" and rest[3] == "" and rest[None] == "x" and len(rest[4]) == 499_999
    assert wrapper.extracted(pages.filter("false")).count() == 0
    assert [r[0] for r in pages.select(wrapper.host(F.col("url")).alias("h")).distinct().orderBy("h").collect()] == ["", "a.example", "b.example"]
