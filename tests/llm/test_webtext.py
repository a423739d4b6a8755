import html
import re

from pyspark.sql import functions as F

from agentcorpus.llm import webtext
from agentcorpus.llm.queries import QUERIES

PAGE = """<!doctype html><html><head><title>Nope</title><style>p{}</style><script>var x="<p>no</p>";</script></head>
<body><header><h1>Site name</h1><p>A slogan, long enough, to count; as text.</p></header>
<nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav><!-- <p>hidden</p> -->
%s
<div class="cookie-notice">We use cookies, to improve, your experience.</div>
<form><p>Sign up for news, please, it is free.</p><input name=q></form>
<div class="comments"><p>I liked this article, very much, thanks for the writing of it.</p></div>
<footer>&copy; 2020, all of us.</footer></body></html>"""
BODY = """<h1>A  title</h1><p>First paragraph, with <b>bold</b> &amp; many words. It goes on,
and on.<p>Short.<p>Third, with a <a href=y>link</a> inside; and caf&eacute; text&nbsp;here."""
TEXT = "A title\nFirst paragraph, with bold & many words. It goes on, and on.\nShort.\nThird, with a link inside; and café text here."


def test_article_and_plain_container():
    assert webtext.main_text(PAGE % f"<article>{BODY}</article>") == TEXT
    assert webtext.main_text(PAGE % f"<div id=main>{BODY}</div>") == TEXT
    side = '<div class="sidebar"><p>Buy now, a great offer, for all of you.</p></div>'
    assert webtext.main_text(PAGE % f"{side}<div>{BODY}</div>{side}") == TEXT


def test_layout_wrappers_and_one_form_around_the_page():
    for inner in (f"<article>{BODY}</article>", f"<main>{BODY}</main>", f"<div>{BODY}</div>"):
        for name in ("no-sidebar", "layout with-sidebar", "has-fixed-header", "has-comments"):
            assert webtext.main_text(f'<body><div class="{name}">{inner}</div></body>') == TEXT
        assert webtext.main_text(f"<body><form id=aspnetForm>{inner}</form></body>") == TEXT
    opened, closed = '<body><form id=f><div class="with-sidebar">', "</div></form></body>"
    page = (PAGE % f"<article>{BODY}</article>").replace("<body>", opened).replace("</body>", closed)
    assert webtext.main_text(page) == TEXT
    long = '<div class="comments">' + "<p>I liked this, very much, thanks for it.</p>" * 6 + "</div>"
    assert webtext.main_text(f"<body><div id=main>{BODY}</div>{long}</body>") == TEXT


def test_hidden_parts_are_those_of_their_attributes():
    for shown in ('style="overflow:hidden"', 'class="overflow-hidden" style="margin:0"', 'aria-label="hidden"',
                  'class="overflow-hidden" aria-label="x"', 'data-role="search"', 'data-id="sidebar"',
                  'aria-hidden="false"', 'title="display:none"', "data-x='a role=menu'"):
        for tag in ("article", "div"):
            assert webtext.main_text(PAGE % f"<{tag} {shown}>{BODY}</{tag}>") == TEXT, shown
    secret = "<p>This is a long, hidden paragraph, with marks; it is not to be read.</p>"
    for hidden in ("hidden", 'hidden=""', 'style="color:red; display : none"', "aria-hidden=true",
                   "class=x style=visibility:hidden"):
        assert webtext.main_text(PAGE % f"<article>{BODY}<div {hidden}>{secret}</div></article>") == TEXT, hidden


def test_named_parts_inside_the_article():
    other = "<p>Some more words, of other people; they are not the article.</p>"
    for name in ("post-comments", "article-share", "content-sidebar", "entry-footer", "main-menu", "postComments",
                 "story related", "article__newsletter"):
        for where in ("class", "id"):
            inner = f'<div {where}="{name}">{other}</div>'
            assert webtext.main_text(PAGE % f"<article>{BODY}{inner}</article>") == TEXT, name
            assert webtext.main_text(PAGE % f"<div class=content>{BODY}{inner}</div>") == TEXT, name
    for name in ("entry-header", "post-header", "article-masthead"):
        head = f'<div class="{name}"><h1>A title</h1><p>By somebody, on a day, in a place.</p></div>'
        assert webtext.main_text(PAGE % f"<article>{BODY.replace('<h1>A  title</h1>', head)}</article>") == TEXT, name


def brute_values(blocks):
    """Ratios of paths, written down plainly."""
    ratio = {}
    for path in {b.path for b in blocks}:
        mine = [b for b in blocks if b.path == path]
        own = [0 if b.aside else max(0, len(b.text) - 2 * b.linked) for b in mine]
        marks = sum(sum(c in ",.;:!?" for c in b.text) for b, n in zip(mine, own) if n)
        ratio[path] = sum(own) / len(mine) * (1 + marks / len(mine))
    along = [ratio[b.path] for b in blocks]
    smooth = [
        0.25 * along[max(i - 1, 0)] + 0.5 * along[i] + 0.25 * along[min(i + 1, len(along) - 1)]
        for i in range(len(along))
    ]
    means = {p: [s for s, b in zip(smooth, blocks) if b.path == p] for p in ratio}
    return {p: (sum(v) / len(v) * ratio[p]) ** 0.5 for p, v in means.items()}


def test_ratios_by_brute_force(spark, sf):
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    for source in [*pages, PAGE % BODY]:
        blocks = webtext.read(source).blocks
        found, want = webtext.path_values(blocks), brute_values(blocks)
        assert found.keys() == want.keys()
        assert all(abs(found[p] - want[p]) <= 1e-9 * max(1, want[p]) for p in want)


def test_time_grows_with_the_page():
    import time

    for unit in ("<div>word, ", "<div><p>x</p></b></span></p></table>", "<ul><li>a", "<li>b"):
        start = time.process_time()
        webtext.main_text(unit * 8000)
        assert time.process_time() - start < 2


def test_query_on_whole_table(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op5_html_main_text"](spark, sf).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        parts = [html.unescape(re.sub(r"<[^>]*>?", " ", p)) for p in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(" ".join(p.split()) for p in parts if p.strip())
        assert r["n_chars"] == len(r["text"])


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "<p"), (4, "just words, no tags"), (5, "<p>cut off &am"), (6, "<nav>menu</nav>"),
            (7, "<div>" * 3000 + "deep text, it is." + "</div>" * 3000), (8, "<p>" + "long text, " * 50_000), (None, "<p>a")]
    frame = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash"))
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in webtext.extract(frame).collect()}
    assert found[1] == found[2] == found[3] == found[6] == ("", 0)
    assert found[4][0] == "just words, no tags" and found[5][0] == "cut off &am"
    assert found[7][0] == "deep text, it is." and found[8][1] == 50_000 * 11 - 1 and found[None][0] == "a"
    assert webtext.extract(frame.limit(0)).collect() == []
