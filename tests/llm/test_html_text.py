import random
import time

import pytest

from lodestrata.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">A link</a></li></ul></nav><div class="ad">Buy, now, this.</div>
<div class="cookie-notice"><p>We use cookies, and so on, and so on, and so on.</p></div>
{}<div id="comments"><p>First, what a post, really, I liked it very much indeed!</p></div>
<form><p>Subscribe, please, to our letter with all the news.</p></form><footer>&copy; all, rights, reserved</footer></body></html>"""


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>Head &amp; line</h1><p>One,  two\n three.</p><p>Four &lt;five&gt; &#233;</article>", "Head & line\nOne, two three.\nFour <five> é"),
        ("<article><h1>Only</h1><p>It.</article>", "Only\nIt."),
        ("<main><section><p>Deep, text, here is long enough to count.</p></section><ul><li>item one</li><li>item two</ul></main>", "Deep, text, here is long enough to count.\nitem one\nitem two"),
        ("<article><p><b>Bold start.<br><p>Next<script>x</script> part</p><!-- no --><blockquote>Quote</blockquote></article>", "Bold start.\nNext part\nQuote"),
        ("<div class=post><p>A story, told in several words, with commas, and more of it to come.</p><p>And, then, another paragraph that goes on for a while.</p></div>",
         "A story, told in several words, with commas, and more of it to come.\nAnd, then, another paragraph that goes on for a while."),
    ],
)
def test_article_is_found(body, text):
    assert html_text.main_text(PAGE.format(body)) == text


PROSE = "".join(f"<p>Part {i}, of a story, told in several words, with commas, and more, and more of it to come.</p>" for i in range(5))
STORY = "\n".join(f"Part {i}, of a story, told in several words, with commas, and more, and more of it to come." for i in range(5))
TABLE = "<table><tr><td>cell</td></tr></table><ul><li>item</li></ul>"
ASIDE = '<aside>not this</aside><ul><li><a href="/r">related</a></li></ul>'


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f"<article><h1>T</h1><div class=body>{PROSE}</div>{TABLE}loose <b>text</b><section>short end</section></article>", f"T\n{STORY}\ncell\nitem\nloose text\nshort end"),
        (f"<article><section><h2>T</h2><div>{PROSE}</div></section><section>short end</section></article>", f"T\n{STORY}\nshort end"),
        (f"<main><div><h1>T</h1></div><article><div>{PROSE}</div></article><p>End.</p></main>", f"T\n{STORY}\nEnd."),
        (f"<main><h1>T</h1><article><div>{PROSE}</div></article><article><a href=x>Other</a> one</article></main>", f"T\n{STORY}"),
        (f"<div><h1>T</h1>loose <b>text</b><div>{PROSE}</div>{TABLE}<figure>a figure</figure><pre>a = 1</pre><section>short end</section>{ASIDE}</div>",
         f"T\nloose text\n{STORY}\ncell\nitem\na figure\na = 1\nshort end"),
    ],
)
def test_nested_articles_are_whole(body, text):
    assert html_text.main_text(PAGE.format(body)) == text


@pytest.mark.parametrize("name", "comment-body sidebar-content promo-text post-comments related-content main-navigation article-ad story-share".split())
def test_parts_beside_the_article_go_whatever_else_their_name_says(name):
    body = f'<article><div class="{name}"><p>Not this, or that, or anything else that is said here.</p></div>{PROSE}</article>'
    assert html_text.main_text(PAGE.format(body)) == STORY
    assert html_text.main_text(PAGE.format(body.replace("class=", "id="))) == STORY


@pytest.mark.parametrize("name", ["post-header", "entry-content", "content no-sidebar", "main with-sidebar", "article-body"])
def test_parts_of_the_article_stay(name):
    assert html_text.main_text(PAGE.format(f'<div class="{name}"><h2>Head</h2>{PROSE}</div>')) == f"Head\n{STORY}"


def test_an_article_in_a_part_with_a_misleading_name():
    assert html_text.main_text(f'<body><div class="widget-text">{PROSE}</div></body>') == STORY


def test_deep_and_wide_pages_take_linear_time():
    n = 100_000
    began = time.perf_counter()
    assert html_text.main_text("<div>" * n + "<p>deep text, in here") == "deep text, in here"
    assert html_text.main_text("<main>" + "<div></section>" * n + "<p>deep text, in here") == "deep text, in here"
    assert html_text.main_text("<main>" + "<span>" * n + "<div>a</div>" * 1000 + "</main>") == "\n".join("a" * 1000)
    assert html_text.main_text("<article>" + "<p>so, it, goes" * n) == "\n".join(["so, it, goes"] * n)
    assert time.perf_counter() - began < 40


#: Attributes and comments that are not as they should be.
ODD = [" title=Bob's", ' title="x""', " '", ' "', " =x", " = 'x'", ' a="1"b', " a='>'", ' a=">"', " a=x=y'z", " /", " a= ", ' title = "a > b"', " data='it is \"so\"'"]
COMMENTS = ["<!-- no -->", "<!-->", "<!--->", "<!-- a --!>", "<!---->", "<!doctype x>", "<?x y?>"]


def page_with_article(rng):
    """A random page and the text of its article, made side by side."""
    word = lambda: rng.choice(["river", "stone", "light,", "garden", "été", "walk.", "slow", "bread,", "north", "glass"])
    marks = {"&": "&amp;", "<": "&lt;", ">": "&#62;", "é": rng.choice(["é", "&eacute;", "&#xe9;"])}
    page, blocks = [], []
    odd = lambda: rng.choice(["", "", "", *ODD])

    def words(n):
        return [rng.choice([word(), word(), word(), "a&b", "<x>"]) for _ in range(n)]

    def inline(ws):
        out, text = [], " ".join(ws)
        for w in ws:
            w = "".join(marks.get(c, c) for c in w)
            out.append(rng.choice([w, w, w, f"<b{odd()}>{w}</b>", f'<span class="x"{odd()}>{w}</span>', f"<a href='/y'{odd()}>{w}</a>" if rng.random() < 0.1 else w, f"{rng.choice(COMMENTS)}{w}"]))
        blocks.append(text)
        return rng.choice([" ", "\n  ", "\t"]).join(out)

    def aside():
        said = " ".join(words(rng.randint(3, 30))).replace("&", "&amp;").replace("<", "&lt;")
        kind = rng.choice(["nav", "aside", "footer", "form", "script", "style", "ad", "comments", "sidebar", "cookie-notice", "related-posts", "share"])
        if kind in ("script", "style"):
            return f"<{kind}>var x = '<p>';</{kind}>"
        return f"<{kind}><p>{said}</p></{kind}>" if kind in ("nav", "aside", "footer", "form") else f'<div class="{kind}"><p>{said}</p></div>'

    def part():
        kind = rng.choice("p p p p h2 ul quote table div section".split())
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{inline(words(rng.randint(2, 8)))}{rng.choice(['</li>', ''])}" for _ in range(rng.randint(1, 4))) + "</ul>"
        if kind == "quote":
            return f"<blockquote><p>{inline(words(12))}</p></blockquote>"
        if kind == "table":
            return "<table>" + "".join(f"<tr><td>{inline(words(2))}<td>{inline(words(2))}" for _ in range(2)) + "</table>"
        if kind in ("div", "section"):
            return f"<{kind}>{part()}{part()}</{kind}>"
        return f"<{kind}{rng.choice(['', ' class=notice-period', ' id=menu-title'])}{odd()}>{inline(words(rng.randint(3, 50)))}" + (f"</{kind}>" if kind == "h2" else rng.choice(["</p>", ""]))

    page.append("<html><head><title>no</title></head><body><header><p>Site, name</p></header>" + aside() + aside())
    page.append(rng.choice(["<main>", "<main><div>", ""]) + "<article>")
    page.append(f"<h1>{inline(words(5))}</h1>")
    for _ in range(rng.randint(3, 12)):
        page.append(part())
        if rng.random() < 0.25:
            page.append(aside())
    page.append("</article></main>" + aside() + aside() + "<footer>&copy; us</footer></body></html>")
    return "".join(page), "\n".join(blocks)


def test_articles_of_random_pages_are_read_back_exactly():
    rng = random.Random(11)
    for _ in range(400):
        page, text = page_with_article(rng)
        assert html_text.main_text(page) == text, page


def test_broken_pages():
    page = "<html><body><article><p>Text that &amp goes on, here, <a href='x"
    assert html_text.main_text(page) == "Text that & goes on, here,"
    assert html_text.main_text("a < b") == "a < b" or html_text.main_text("a < b") == ""
    for bad in ("", "<", "<p", "</p></p>", "<!--", "<script>", "<article>" * 3000 + "<p>deep"):
        html_text.main_text(bad)
    assert html_text.main_text("<article>" * 3000 + "<p>deep text, in here") == "deep text, in here"


def test_table(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>x y</article>"), (3, "u", "<article><p>same</article>"), (3, "u", "<article><p>same</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_text.extract_main_text(df.withColumn("text", df.url)).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, "", 0), (2, "", 0), (None, "x y", 3), (3, "same", 4), (3, "same", 4)]
    assert html_text.extract_main_text(df.limit(0)).collect() == []


@pytest.mark.parametrize("odd", ["<p title=Bob's>", '<p title="x"">', '<p class="a" b"c>', "<p '>", '<p a = "1">', '<p title="never closed>', "<p title='never>", "<p =>", "<p class=notice-period>", "<!--><p>", "<p/ x>"])
def test_nothing_is_lost_behind_an_odd_tag(odd):
    page = f"<body><nav>a, b</nav><article><p>One, two, three.</p>{odd}Four, five, six.</p><p>Seven, eight, nine.</p></article><footer>no</footer></body>"
    assert html_text.main_text(page) == "One, two, three.\nFour, five, six.\nSeven, eight, nine."


def test_quotes_behind_an_equals_sign_hold_anything():
    assert html_text.main_text("<article><p title=\"a > b 'c\">So, it, goes.</p></article>") == "So, it, goes."


@pytest.mark.parametrize(("tag", "stays"), [("p class=cookie-notice", False), ("p class=notice-period", True), ("h2 id=menu-title", True), ("div class=notice-period", False), ("h3 class='share'", False)])
def test_words_of_paragraphs_in_an_article(tag, stays):
    name = tag.split()[0]
    page = f"<article>{PROSE}<{tag}>The, last, words.</{name}></article>"
    assert html_text.main_text(page) == STORY + "\nThe, last, words." * stays
    linked = f"<article>{PROSE}<{tag}><a href=x>The, last, words.</a></{name}></article>"
    assert html_text.main_text(linked) == STORY


def plain_points(root):
    """Points of every node by their definition, each from a look at all that is below it."""
    text = lambda n: "".join(c if isinstance(c, str) else text(c) for c in n.children)
    linked = lambda n: text(n) if n.name == "a" else "".join(linked(c) for c in n.children if not isinstance(c, str))
    size = lambda s: len("".join(s.split()))
    density = lambda n: size(linked(n)) / size(text(n)) if size(text(n)) else 0
    below = lambda n, d=0: [(c, d + 1) for c in n.children if not isinstance(c, str)] + [x for c in n.children if not isinstance(c, str) for x in below(c, d + 1)]
    out = {}
    for node in [root, *(n for n, _ in below(root))]:
        points = 0
        for p, d in below(node):
            share = 1.0 if d == 1 else 0.5 / 3 ** (d - 2)
            if p.name in html_text.PARAGRAPH and size(text(p)) and share >= 0.1:
                value = 1 + text(p).count(",") + min(size(text(p)) / 100, 3)
                points += value * share * (0.2 if p.name[0] == "h" or p.name == "li" else 1) * (1 - density(p))
        own = sum(size(c) for c in node.children if isinstance(c, str))
        points += 1 + own / 100 if node.name in ("div", "section", "article", "main") and own >= 25 else 0
        points += 5 if node.name in ("article", "main") and size(text(node)) else 0
        out[id(node)] = points * (1 - density(node))
    return out


def test_points_by_definition():
    rng = random.Random(3)
    for _ in range(60):
        root = html_text.parse(page_with_article(rng)[0])
        plain = plain_points(root)
        for node in html_text._score(root):
            assert node.points == pytest.approx(plain[id(node)]), node.name
