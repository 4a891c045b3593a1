import pytest

from defectflow.llm.html_text import extract_text, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav><!-- ad <article> -->
<div class="cookie-notice">We use cookies. %s</div>
<div class="ad">Buy   now</div><article><header><h1>The title</h1></header><p><b>First &amp; best
  line&period;<br>goes on<p>Second &lt;p&gt; &eacute;&#233;&#xE9; &notanentity; &amp</p>
<aside>Related: x</aside><form><label>Name</label><input><textarea>t</textarea></form><ul><li>one<li>two</ul>
<table><tr><td>cell a</td><td>cell b</td></tr></table><p>a.</p><div class="share">Share</div><p>Last 1 < 2.</p>
<section id="comments"><article class="comment"><p>First!</p></article></section></article>
<div id="sidebar"><p>%s</p></div><footer>&copy; Site</footer></body></html>""" % ("long notice " * 40, "side text " * 90)
TEXT = (
    "The title\nFirst & best line. goes on\nSecond <p> ééé &notanentity; &\none\ntwo\ncell a\ncell b\na.\nLast 1 < 2."
)


def test_article():
    # "&not" is a reference without a semicolon, as in browsers
    assert main_text(PAGE) == TEXT.replace("&notanentity;", "¬anentity;")


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("   ", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"),
    ("<article><p>cut off <b>her", "cut off her"), ("<article><p>x</p><p>y <a href='", "x\ny"), ("<article>x &am", "x &am"),
    ("<script>never closed <p>x</p>", ""), ("<!-- never closed <p>x</p>", ""), ("<nav>menu<article><p>text</p></article>", "text"),
    ("<article></article><footer>f</footer>", ""), ("<div><p>only</p><p>paragraphs</p></div>", "only\nparagraphs"),
    ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p></article>", "yes"),
    ("<article>a<hr>b<h2>c</h2>d</article>", "a\nb\nc\nd"), ("<article>a&nbsp; b\t\n c</article>", "a b c"),
    ("<main><div class='notice'>n</div>text</main>", "text"), ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
    ("<article><p title=\"a > b\">t</p></article>", "t"), ("<article>1 < 2 <3 </ x></article>", "1 < 2 <3"),
])
def test_cases(page, text):
    assert main_text(page) == text


def test_longest_stretch_without_article():
    menu = "".join(f"<li><a href='/{i}'>item {i}</a></li>" for i in range(30))
    page = f"<div><ul>{menu}</ul></div><div><p>{'body text ' * 20}</p><p>end.</p></div><footer>f</footer><p>stray</p>"
    assert main_text(page) == "body text " * 19 + "body text\nend."


A, B = "long text of the first part " * 30, "long text of the second part " * 30


@pytest.mark.parametrize("between", [
    "<script>x()</script>", "<style>p{}</style>", "<iframe src=x></iframe>", "<svg><text>s</text></svg>", "<button>b</button>",
    "<form><label>l</label></form>", "<aside>a</aside>", "<div class='ad'>buy</div>", "<div class='notice'>n</div>",
    "<nav><a href='/'>home</a></nav>", "<ul><li><a href='/x'>link</a></li></ul>", "<p><a name='top'></p>",
])
def test_nothing_else_is_dropped_without_article(between):
    want = f"{A.strip()}\n{B.strip()}"
    assert main_text(f"<div><p>{A}</p>{between}<p>{B}</p></div>") == want
    assert main_text(f"<nav>menu</nav><div><a name='top'><p>{A}</p>{between}<p>{B}</p></div><footer>f</footer><p>stray</p>") == want


def test_links_scripts_and_classes_in_text():
    linked = f"<p>{A}</p><p><a href='/1'>mostly</a> <a href='/2'>links</a></p><p>{B}</p>"
    assert main_text(f"<div>{linked}</div>") == f"{A.strip()}\nmostly links\n{B.strip()}"
    assert main_text("<div><p>one <script>x()</script>line<svg></svg>here</p></div>") == "one line here"
    page = "<article><h2 id='social'>Social</h2><p class='alert'>Text</p><div class='share'>s</div><p id='related'>End</p></article>"
    assert main_text(page) == "Social\nText\nEnd"
    assert main_text(f"<article><p>{A}</p></article><div><p>{B[:300]}</p></div>") == A.strip()


def test_table(spark):
    rows = [(1, "u", PAGE, "clash"), (2, None, None, "clash"), (2, None, None, "clash"), (3, "v", "<p>" + "x" * 300_000, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = extract_text(pages)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(len(r.text) for r in got.collect()) == [0, 0, len(main_text(PAGE)), 300_000]
    assert extract_text(pages.limit(0)).count() == 0
