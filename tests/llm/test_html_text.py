import random
from html.parser import HTMLParser

from flowgauge.llm.html_text import common_lines, main_texts, page_lines, query
from pyspark.sql import functions as F

from tests.llm.conftest import SMALL

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>"</script></head><body class="has-sidebar">
<nav><ul><li><a href="/a">Menu</a></ul></nav><!-- ad --><div class="ad">Buy</div><header>Site</header>
<article><h1>Title &amp; more</h1><p><b>One
  two.<br><p>Thr&eacute;e &lt;x&gt;</p><aside>side</aside><form>mail <input></form><div class="comments"><p>Nice</div><p>End</article>
<footer>&copy; site</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own")).withColumn("key", F.lit(1))


def test_lines_of_a_page():
    lines, kinds = page_lines(PAGE)
    assert [line for line, kind in zip(lines, kinds) if kind == "a"] == ["Title & more", "One two.", "Thrée <x>", "End"]
    assert "o" not in kinds
    for broken in ("<", "<p", "<p class='", "<!--", "<script>", "a < b", "</x>", "<div" * 5000, "<p \"" * 5000, "&amp", "<b>" * 5000):
        page_lines(broken)


def test_nothing_but_the_named_is_dropped_in_an_article():
    page = """<article><h2 id="related-work">Related work</h2><section id="search-api"><p>Search text</p></section>
    <div class="social-impact" id="comments-on-x"><p>Impact</p></div><p>Let <math><mi>a</mi><mo>+</mo><mi>b</mi></math> be</p>
    <object data="x"><p>Object text</p></object><canvas>Canvas text</canvas><video>Video text</video><xmp>1 <b> 2 &amp;</xmp>
    <div class="box share"><p>Share it</p></div><div role="search">Find</div><p>End</p></article>"""
    lines, kinds = page_lines(page)
    kept = [line for line, kind in zip(lines, kinds) if kind == "a"]
    assert kept == [
        "Related work", "Search text", "Impact", "Let a+b be", "Object text", "Canvas textVideo text", "1 <b> 2 &amp;", "End"
    ]
    assert kinds.count("h") == 2 and page_lines("<p>x</p><div id='search-box'>y</div><video>z</video>")[1] == "obb"


def test_common_lines():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        found, rest = common_lines(a, b), iter(b)
        assert len(found) == table[-1][-1] and all(a[at] in rest for at in found)


def test_template_goes_and_text_stays(spark):
    def plain(body):
        return f"<div>Home of things</div><p>Shared line</p>{body}<p>Last words of all</p>"

    rows = [
        (1, "http://h.example/a/1", plain("<p>First text of a page.</p><p>More of it.</p>")),
        (2, "http://h.example/a/2", plain("<p>Second text, not the first.</p>")),
        (3, "http://h.example/b/9", plain("<p>Third text stands further away.</p>")),
        (4, "http://alone.example/", plain("<p>No other page here.</p>")),
        (5, "http://h.example/a/1?copy", plain("<p>First text of a page.</p><p>More of it.</p>")),
        (6, "http://g.example/1", "<article><p>Passage that both have.</p><p>One.</p></article>"),
        (7, "http://g.example/2", "<article><p>Passage that both have.</p><p>Two.</p></article>"),
        (8, None, None), (9, "", ""), (9, "", ""), (None, "http://h.example/c", plain("<p>Without id.</p>")),
    ]
    found = main_texts(spark, pages(spark, rows)).collect()
    text = {r.page_id: r.text for r in found}
    assert len(found) == len(rows) and all(r.key == 1 for r in found)
    assert text[1] == text[5] == "First text of a page.\n\nMore of it."
    assert text[2] == "Second text, not the first." and text[3] == "Third text stands further away."
    assert text[4].startswith("Home of things")
    assert text[6] == "Passage that both have.\n\nOne." and text[8] == text[9] == "" and text[None] == "Without id."


def test_short_pages_under_a_long_menu(spark):
    menu = "<nav>" + "".join(f"<li>Menu entry number {i:03d}</li>" for i in range(100)) + "</nav>"
    rows = [
        (i, f"http://m.example/p/{i:03d}", f"{menu}<p>{'Welcome to the site. ' * 14}</p><p>{f'Own words of page {i}. ' * 14}</p>")
        for i in range(6)
    ]
    for row in main_texts(spark, pages(spark, rows)).collect():
        assert row.text == (f"Own words of page {row.page_id}. " * 14).strip(), row.page_id


def test_teasers_do_not_replace_larger_open_text(spark):
    body = "Long text in a div of the page number {0}. " * 9
    rows = [
        (i, f"http://t.example/{i}", f"<p>Open template line of all</p><div>{body.format(i)}</div><article><p>Teaser {i}</p></article>")
        for i in range(3)
    ]
    rows += [(8, "http://a.example/1", f"<p>Short open line</p><article><p>{body}</p></article>")]
    rows += [(9, "http://b.example/1", f"<div>{body}</div><main><p>Main text</p></main>")]
    text = {r.page_id: r.text for r in main_texts(spark, pages(spark, rows)).collect()}
    for i in range(3):
        assert text[i] == f"{body.format(i).strip()}\n\nTeaser {i}"
    assert text[8] == body.strip() and text[9] == "Main text"


def test_pairs_do_not_depend_on_parts(spark):
    rows = [(i, f"http://h.example/p/{i:03d}", f"<p>top {i // 10}</p><p>own {i}</p><p>bottom</p>") for i in range(60)]
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted((r.page_id, r.text) for r in main_texts(spark, pages(spark, rows)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] and all("bottom" not in text and f"own {i}" in text for i, text in results[0])


def test_no_pages(spark):
    assert main_texts(spark, pages(spark, [])).count() == 0


LAYOUTS = [
    # What is no article by class or id, inside article and main; the rest stays.
    ('<article><p>A</p><section id="comments"><h2>Replies</h2><p>Nice</p></section></article>', "A"),
    ('<main><p>A</p><div class="comments-area"><p>Nice</p></div><p>B</p></main>', "A\n\nB"),
    ('<article><p>A</p><article class="comment"><p>Nice</p></article></article>', "A"),
    ('<article class="post"><p>A</p></article><article class="comment-body"><p>Nice</p></article>', "A"),
    ('<article><div class="cookie-banner">We use</div><p>A</p><div class="ad-slot">Buy</div><p>B</p></article>', "A\n\nB"),
    ('<main><p>A</p><ul class="related-posts"><li>C</li></ul><div class="post-navigation"><p>Next</p></div></main>', "A"),
    ('<article><p>A</p><div id="sidebar-left">S</div><div id="cookie-notice">N</div><div class="share_buttons">S</div></article>', "A"),
    # Headings, generated ids and compound names that hold a hint.
    ('<article><h2 id="comments">Comments</h2><section id="cookies"><p>Of cookies</p></section></article>', "Comments\n\nOf cookies"),
    ('<main><div class="has-sidebar no-ads"><p>A</p></div><div class="ad-hoc"><p>B</p></div></main>', "A\n\nB"),
    ('<article class="post tag-promo comments-open"><div class="share">Share</div><p>A</p></article>', "A"),
    ('<article><div class="widget"><p>All of the text</p></div></article>', "All of the text"),
    # Tags as HTML reads them.
    ('<article><p>A <a title="1 < 2 > 0" href="x">link</a></p></article>', "A link"),
    ('<article><!--><p>B</p><!-- x --><!---><p>C</p><!-- y --!><p>D</p></article>', "B\n\nC\n\nD"),
    ("<article><p data-x='a>b' \">E</p><p title = \"</p>\">F</p></article>", "E\n\nF"),
]


def test_layouts(spark):
    rows = [(i, f"http://{i}.example/", source) for i, (source, _) in enumerate(LAYOUTS)]
    found = {r.page_id: r.text for r in main_texts(spark, pages(spark, rows)).collect()}
    for i, (source, text) in enumerate(LAYOUTS):
        assert found[i] == text, source


class Tree(HTMLParser):
    """A slow second reader of well-formed pages: lines of the article, with what stands in named elements left out."""

    def __init__(self):
        super().__init__()
        self.path, self.lines, self.line = [], [], ""

    def end(self):
        line = " ".join(self.line.split())
        self.line = ""
        if line and any(tag == "article" for tag, _ in self.path) and not any(self.left_out(*step) for step in self.path):
            self.lines.append(line)

    @staticmethod
    def left_out(tag, attributes):
        return tag in ("nav", "aside", "form", "footer") or dict(attributes).get("class") in ("comments-area", "ad-slot", "menu")

    def handle_starttag(self, tag, attributes):
        if tag not in ("b", "a"):
            self.end()
        self.path.append((tag, attributes))

    def handle_endtag(self, tag):
        if tag not in ("b", "a"):
            self.end()
        self.path.pop()

    def handle_data(self, data):
        self.line += data


def test_random_pages_against_a_second_reader():
    rng = random.Random(5)

    def node(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["one ", " two &lt; &eacute;", "\n three", "4 > 3 ", "<b>bold</b> text", '<a title="a < b">link</a>'])
        tag = rng.choice(["div", "section", "ul", "nav", "aside", "form", "footer", "div", "section", "blockquote"])
        name = rng.choice(["", "", "", ' class="comments-area"', " class='ad-slot'", ' class="menu"', ' class="text" id="a=b"'])
        return f"<{tag}{name}>{''.join(node(depth - 1) for _ in range(rng.randint(0, 4)))}</{tag}>"

    for _ in range(400):
        source = f"<div>{node(2)}</div><article>{''.join(node(4) for _ in range(3))}</article>{node(1)}"
        reader = Tree()
        reader.feed(source)
        reader.close()
        lines, kinds = page_lines(source)
        assert [line for line, kind in zip(lines, kinds) if kind == "a"] == reader.lines, source


class GivenPage(HTMLParser):
    """A second reader of the given pages, in which paragraphs and bold text stay open: blocks of the article element."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attributes):
        self.inside = self.inside or tag == "article"
        if tag in ("article", "h1", "p"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        if tag in ("article", "h1", "p"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data

    def text(self):
        lines = (" ".join(block.split()) for block in self.blocks)
        return "\n\n".join(line for line in lines if line)


def test_every_given_page_against_a_second_reader(spark):
    given = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    found = query(spark, SMALL).collect()
    assert len(found) == len(given) > 0
    for r in found:
        reader = GivenPage()
        reader.feed(given[r.page_id].html or "")
        reader.close()
        assert r.text == reader.text() and r.url == given[r.page_id].url and r.n_chars == len(r.text), r.url
