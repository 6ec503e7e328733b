import html
import random
import re
import time

import pytest

from briarlake.llm.html import extract_pages, main_text, parse, set_marks_aside, weigh
from briarlake.llm.queries import op2_html_extraction
from tests.llm import brute

LONG = "Some long text in this paragraph with many words in it, right here."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &lt;text&gt; only", "plain <text> only"),
        ("<p>one<p>two<br>three", "one\ntwo three"),
        ("<script>x", ""),
        ("<p", ""),
        ("<", "<"),
        (f"<body><nav><a href=a>Home</a></nav><div id=x><h1>Head</h1><p>{LONG}</p><p>{LONG} &amp; more&nbsp;text</p></div><footer>&copy; me</footer></body>", f"Head\n{LONG}\n{LONG} & more text"),
        (f"<article><h1>T</h1><p>{LONG}</p><div class='comment-list'><p>{LONG}</p></div><form>{LONG}</form><aside>{LONG}</aside></article>", f"T\n{LONG}"),
        (f"<article><header class='entry-header'><h1>T</h1></header><p>{LONG}</p></article><div class='cookie-notice'><p>{LONG}</p></div>", f"T\n{LONG}"),
        (f"<article><p>a  <b>b\n c</b>d</p><style>p{{}}</style><!-- {LONG} --><p>{LONG}</p></article>", f"a b cd\n{LONG}"),
        (f"<div><div><p>{LONG}</p><p>x.</p></div><div><p>{LONG}</p></div></div><div><a href=x>l</a> <a href=y>m</a></div>", f"{LONG}\nx.\n{LONG}"),
        (f"<form id='aspnet'><div><p>{LONG}</p></div></form><footer>x</footer>", LONG),
        (f"<div class='page with-sidebar'><div class='post'><p>{LONG}</p></div><div class='left-sidebar'><p>{LONG}</p></div><div id='topnav'>{LONG}</div></div>", LONG),
        (f"<div class='wrap'><div class='post'><p>{LONG}</p><p>{LONG}</p></div><section id='user-comments'><h3>Comments</h3><p>{LONG} {LONG}</p></section></div>", f"{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p><script>var t='</p>';</script><p title='a>b'>{LONG}</p></article>", f"{LONG}\n{LONG}"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_deep_and_long_pages():
    assert main_text("<div>" * 20000 + "<p>x y</p>") == "x y"
    assert len(main_text("<article>" + f"<p>{LONG}</p>" * 20000 + "</article>")) == 20000 * (len(LONG) + 1) - 1


def test_table(spark):
    pages = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>", "x"), (1, "u", f"<p>{LONG}</p>", "x"), (None, None, None, "x")], "page_id long, url string, html string, text string")  # text: a clashing name
    assert sorted(extract_pages(pages).collect(), key=str) == sorted([(1, "u", LONG, len(LONG))] * 2 + [(None, None, "", 0)], key=str)
    assert extract_pages(pages.limit(0)).count() == 0


def article_text(page):
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
    return "\n".join(b for b in blocks if b)


def test_query_against_article_elements(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{brute.SMALL}/pages.parquet").collect()}
    for r in op2_html_extraction(spark, brute.SMALL).collect():
        assert r.text == article_text(pages[r.page_id]) and r.n_chars == len(r.text)


def test_density_decides_without_names(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    plain = [re.sub(r' (class|id)="[^"]*"', "", p) for p in pages]
    assert sum(main_text(p) == article_text(p) for p in plain) >= 0.95 * len(pages)
    bare = [re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", p) for p in plain]
    assert sum(main_text(b) == article_text(p) for b, p in zip(bare, plain, strict=True)) >= 0.85 * len(pages)


def test_densities_against_recursion():
    draw = random.Random(5)

    def grow(depth):
        parts = []
        for _ in range(draw.randrange(4)):
            if draw.random() < 0.5 or not depth:
                parts.append("x" * draw.randrange(1, 60) + " y")
            else:
                parts.append((draw.choice(["div", "span", "a", "section", "b"]), grow(depth - 1)))
        return parts

    def write(node):
        return f"<{node[0]}>" + "".join(x if isinstance(x, str) else write(x) for x in node[1]) + f"</{node[0]}>"

    for _ in range(300):
        tree = ("body", grow(5))
        root = parse(write(tree))
        set_marks_aside(root)
        nodes = weigh(root)
        want = brute.densities(tree)
        assert len(want) == len(nodes) - 1
        assert [x for n in nodes[1:] for x in (n.density, n.total)] == pytest.approx([y for x in want for y in x])
        assert nodes[1].best.total == pytest.approx(max(x[1] for x in want))


@pytest.mark.parametrize(
    "page",
    [
        "<div class='sidebar'>Side text here</div><div class=ad>Buy now cheap</div><div id=comments>First! great post</div>",
        "<form><label>Name</label><input name=a><input type=password><button>Sign in</button></form>",
        "<nav><a href=x>Home</a></nav><footer>c</footer>",
    ],
)
def test_pages_without_an_article_are_empty(page):
    assert main_text(page) == ""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>" + "İstanbul İzmir " * 40 + f"</p><script>var a = 1</script><p>{LONG}</p>", ("İstanbul İzmir " * 40).strip() + "\n" + LONG),
        (f"<article><p>{LONG}</p><p>is <math><mi>E</mi></math> and more</p></article>", f"{LONG}\nis E and more"),
        (f"<article><p>{LONG}</p><section class='related-work'><p>Other work</p></section><section class='popular-science'>Science</section></article>", f"{LONG}\nOther work\nScience"),
        (f"<form><input type=hidden><div class='comments-open'><div class='widget Blog'><h1>T</h1><p>{LONG}</p></div></div></form><div>credit</div>", f"T\n{LONG}"),
        (f"<article><p>{LONG}</p></article><section id=comments>" + f"<article><p>{LONG} {LONG}</p></article>" * 9 + "</section>", LONG),
        (f"<div>{LONG} {LONG}</div><div><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG} {LONG}\n{LONG}\n{LONG}"),
        (f"<div><p>{LONG}</p><p>{LONG}</p><ul><li><a href=1>aa bb</a></li><li><a href=2>cc dd</a></li></ul></div>", f"{LONG}\n{LONG}"),
        ("<p>&am<b></b>p; x</p>", "&amp; x"),
    ],
)
def test_whole_articles(page, text):
    assert main_text(page) == text


ARTICLE = f"<article><h1>T</h1><p>{LONG}</p><p>{LONG}</p></article>"
TEXT = f"T\n{LONG}\n{LONG}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<html><head><title>t</title><meta charset=utf-8><body>{ARTICLE}</body></html>", TEXT),
        (f"<html><head><title>t</title>{ARTICLE}", TEXT),
        (f"<head><title>t</title>{LONG}", LONG),
        (f"<head><noscript><link rel=x></noscript><meta name=y>\n{ARTICLE}", TEXT),
        (f"<body><select><option>EN<option>DE</select>{ARTICLE}", TEXT),
        (f"<body><select><optgroup><option>EN<optgroup><option>DE{ARTICLE}", TEXT),
        (f"<body><noscript><p>Enable JS</noscript>{ARTICLE}", TEXT),
        (f"<body><button><p>x</button>{ARTICLE}", TEXT),
        (f"<body><button>x<button>y</button>{ARTICLE}", TEXT),
    ],
)
def test_omitted_end_tags_lose_no_page(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body>{ARTICLE}<article><h1>U</h1><p>{LONG}</p></article>", f"{TEXT}\nU\n{LONG}"),
        (f"<body><div class=post>{f'<p>{LONG}</p>' * 4}</div><div class=post><p>Short one here.</p></div>", "\n".join([LONG] * 4) + "\nShort one here."),
        (f"<body><h1>Head</h1><div><p>{LONG}</p><p>{LONG}</p></div><div><a href=x>l</a> <a href=y>m</a></div>", f"Head\n{LONG}\n{LONG}"),
        (f"<body><div><p>{LONG}</p><p>{LONG}</p></div><h1>After</h1>", f"{LONG}\n{LONG}"),
        (f"<body>{ARTICLE[:-10]}<div class='advertisement-label'>Advertisement</div><div class='cookie-banner-text'>We use cookies</div><div class='share-buttons'>Share</div><div class='related-posts'>Read this too</div></article>", TEXT),
        (f"<body>{ARTICLE}<div>© 2024 Me</div>", TEXT),
        (f"<body><div><p>{LONG}</p><p>{LONG}</p></div><div>Copyright 2024 by me</div>", f"{LONG}\n{LONG}"),
    ],
)
def test_all_articles_and_headlines_and_no_labels(page, text):
    assert main_text(page) == text


OPTIONAL = re.compile(r"</(?:p|li|dd|dt|tr|td|th|tbody|thead|option|optgroup|head|body|html)>\s*(?=<(?!/?(?:b|i|a|em|span|br|script|!)\b)|$)", re.IGNORECASE)


def test_pages_without_optional_end_tags_give_the_same_text(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").where("html IS NOT NULL").collect()]
    draw, changed = random.Random(8), 0
    for page in pages:
        bare = OPTIONAL.sub(lambda m: "" if draw.random() < 0.7 else m[0], page)
        changed += bare != page
        assert main_text(bare) == main_text(page)
    assert changed > 0.9 * len(pages)


def test_density_changes_the_shipped_result(spark, monkeypatch):
    """Lists of links in plain divs, without a name or an article element: only densities tell them from text."""
    from briarlake.llm import html as module

    menu = "<div>" + "".join(f"<div><a href=/{k}>Link number {k}</a></div>" for k in range(12)) + "</div>"
    pages = [re.search(r"<article>(.*?)</article>", r.html, re.S) for r in spark.read.parquet(f"{brute.SMALL}/pages.parquet").select("html").where("html IS NOT NULL").collect()]
    bodies = [f"<body>{menu}<div>{m[1]}</div>{menu}</body>" for m in pages if m]
    shipped = [main_text(b) for b in bodies]
    assert sum("Link number" not in x and len(x) > 0 for x in shipped) >= 0.95 * len(bodies)
    monkeypatch.setattr(module, "choose", lambda root: {id(root)})
    assert all("Link number" in main_text(b) for b in bodies)


@pytest.mark.parametrize("page", ["<span>" * 20000 + "text" + "</b>" * 20000, "<b><div>" + "<span>" * 20000 + "text" + "</b>" * 20000, "<p><b>" * 20000 + "text"])
def test_linear_time(page):
    began = time.time()
    assert main_text(page) == "text"
    assert time.time() - began < 5
