import html
import math
import random
import re
import time
from xml.etree import ElementTree

from helpers import empty
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenseek.llm import common, extraction

CASES = {
    "": "",
    "<p>hi": "hi",
    "plain": "plain",
    "<html><body><header><h1>Site</h1></header><main><h1>Title</h1><p>x < y &amp; z<p>two<ul><li>one<li>two</ul><pre>a\n b</pre></main><section class='comments'><p>no no no no</p></section><footer>f": "Title\n\nx < y & z\n\ntwo\n\none\n\ntwo\n\na b",
    "<div id=sidebar><p>" + "word " * 100 + "</div><div><p>real article text here, long enough</p><p>second</p></div>": "real article text here, long enough\n\nsecond",
    '<script>if (a<b) x="</p>"</script><p>ok': "ok",
    "<body><div class=post><h2>T</h2><p>one para&nbsp;of text</p><table><tr><td>c1<td>c2</table></div><div class='cookie-notice'>We use cookies": "T\n\none para of text\n\nc1\n\nc2",
    "<article><p>a<b>b</b><i>c</i> d<br>e<!-- x --></p></article><form><p>Sign up now please, it is long</p></form>": "abc d e",
    "<article><h1>T</h1><p>text</p><article class='comment'><p>first!</p></article></article>": "T\n\ntext",
    "<p>" * 500 + "deep" + "<div>" * 500 + "er": "deep\n\ner",
    "&lt;b&gt; &#233; &eacute; &amp;amp; &bogus; &am": "<b> é é &amp; &bogus; &am",
    "<a title='x>y'>z</a> <unknown>w</unknown> <3 t <b": "z w <3 t",
}


def test_cases():
    for page, text in CASES.items():
        assert extraction.main_text(page) == text, page[:80]
    assert extraction.main_text(None) == ""


def article(page):
    """The article of the generated pages, cut out by its tags."""
    inner = re.search("<article>(.*)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", inner))
    return "\n\n".join(b for b in blocks if b)


def test_pages_equal_their_articles(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in common.table(spark, sf, "pages").collect()}
    rows = extraction.op4_html_extraction(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_awkward_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (1, "u", "", "x"), (None, "u", "<p>é", "x"), (1, "u", "<p>é", "x")], "page_id bigint, url string, html string, text string")
    rows = extraction.extract(pages).collect()
    assert [(r["text"], r["n_chars"]) for r in rows] == [("", 0), ("", 0), ("é", 1), ("é", 1)]
    assert extraction.extract(empty(spark).selectExpr("doc_id AS page_id", "lang AS url", "text AS html")).count() == 0


def test_names_do_not_drop_what_holds_the_article():
    story = "".join(f"<p>This is sentence number {i} of the story, which goes on for a while.</p>" for i in range(9))
    text = "\n\n".join(f"This is sentence number {i} of the story, which goes on for a while." for i in range(9))
    menu = "<ul>" + "".join(f"<li><a href=/{i}>entry {i}</a>" for i in range(20)) + "</ul>"
    side = f"<div class='sidebar'>{menu}<p>About us, in some words</p></div><div class='footer-widget'><p>Imprint</p></div>"
    for name in ("content has-sidebar", "elementor-widget-container", "sidebar", "page-with-comments"):
        for inner in (f"<article>{story}</article>", f"<main><div>{story}</div></main>"):
            assert extraction.main_text(f"<body><div class='{name}'>{inner}{side}</div>{side}") == text, name
    for name in ("content has-sidebar", "elementor-widget-container", "no-sidebar ad-free"):
        assert extraction.main_text(f"<body><div class='{name}'><div>{story}</div>{side}</div>{side}") == text, name
        assert extraction.main_text(f"<body><div id=page class='{name}'>{story}</div><div class=comments><p>{'I like it. ' * 200}</p></div>") == text, name
    parts = story.split("</p>")
    widgets = "".join(f"<div class='elementor-element elementor-widget elementor-widget-text'><div class='elementor-widget-container'>{''.join(parts[i : i + 3])}</div></div>" for i in (0, 3, 6))
    assert extraction.main_text(f"<body><div class=row>{widgets}</div>{side}") == text


def test_names_still_drop_the_rest():
    story = "".join(f"<p>This is sentence number {i} of the story, which goes on for a while.</p>" for i in range(9))
    for extra in ("<div class=comments><p>first!</p><article class=comment><p>second!</p></article></div>", "<div class='comment-list'><p>first!</p></div>", "<div class='cookie-notice'><p>We use cookies, as you like them</p></div>"):
        for page in (f"<article>{story}{extra}</article>", f"<div class=has-sidebar><div>{story}{extra}</div></div>"):
            found = extraction.main_text(f"<body>{page}")
            assert found.startswith("This is sentence number 0") and found.count("\n\n") == 8, (page[-200:], found[-200:])


STORY = "".join(f"<p>This is sentence number {i} of the story, which goes on for a while.</p>" for i in range(9))
STORY_TEXT = "\n\n".join(f"This is sentence number {i} of the story, which goes on for a while." for i in range(9))


def test_attributes_are_read_by_their_names():
    kept = {
        '<p title="the hidden truth">Kept one.</p>': "Kept one.",
        '<p data-hidden="false">Kept two.</p>': "Kept two.",
        '<p data-id="sidebar">Kept three.</p>': "Kept three.",
        '<p>See <a href="/x?id=comments">the comments</a> there.</p>': "See the comments there.",
        '<div class="article-header"><h1>A title</h1></div>': "A title",
        '<p class="share-price">It fell to 3.</p>': "It fell to 3.",
        "<p data-x='class=ad' lang=en>Kept four.</p>": "Kept four.",
        '<p class="cookie-recipe" aria-hidden="false">Two eggs.</p>': "Two eggs.",
    }
    for piece, text in kept.items():
        for page in (f"<article>{piece}{STORY}</article>", f"<body><div>{piece}{STORY}</div></body>"):
            assert extraction.main_text(page) == f"{text}\n\n{STORY_TEXT}", piece
    for piece in ("<p hidden>x</p>", "<p HIDDEN=''>x</p>", "<div class='ad-text'>x</div>", "<p class='share-buttons'>x</p>", "<div id=comment-text>x</div>", "<p style='color:red;display: none'>x</p>", "<p aria-hidden=true>x</p>", "<div class=notice>x</div>"):
        assert extraction.main_text(f"<article>{piece}{STORY}</article>") == STORY_TEXT, piece


def plain_density(page):
    """The article by the densities, computed node by node on a parsed tree of well-formed pages without class or id; sums are taken anew for each node."""
    root = ElementTree.fromstring(page)

    def counts(e, linked=False):
        linked = linked or e.tag == "a"
        own = [e.text or "", *(c.tail or "" for c in e)]
        chars = sum(len(t.strip()) for t in own)
        told = [chars, len(e), chars if linked else 0, sum(c.tag == "a" for c in e)]
        for c in e:
            told = [x + y for x, y in zip(told, counts(c, linked))]
        return told

    body = root.find("body")
    body_chars, _, body_links, _ = counts(body)

    def density(e, linked):
        chars, tags, link_chars, link_tags = counts(e, linked)
        if not chars:
            return 0.0
        of_chars, of_tags = link_chars / chars, link_tags / max(1, tags)
        rare = max(0.0, -math.log(min(1.0, of_chars + 0.01) * min(1.0, of_tags + 0.01)))
        return (chars - link_chars) / max(1, tags) * rare / math.log(of_chars / max(0.01, 1 - of_chars) + body_links / max(1, body_chars) + math.e)

    up = {c: e for e in root.iter() for c in e}

    def linked(e):
        return e is not None and (e.tag == "a" or linked(up.get(e)))

    best = max((e for e in body.iter() if e.tag in ("body", "div", "section", "ul")), key=lambda e: sum(density(c, linked(c)) for c in e))
    path = [best]
    while path[-1] is not body:
        path.append(up[path[-1]])
    least = max(0.3 * min(density(e, linked(e)) for e in path if e is not body or best is body), 0.15 * density(best, linked(best)))
    taken = [best, *(c for e in path[1:] for c in e if c not in path and density(c, linked(c)) >= least > 0)]
    return "\n\n".join(" ".join("".join(p.itertext()).split()) for p in body.iter("p") if any(p in set(t.iter()) for t in taken))


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32))
def test_pages_without_article_elements_equal_a_plain_computation(seed):
    rng = random.Random(seed)

    def words(n):
        return " ".join("word%d" % rng.randrange(1000) for _ in range(n))

    def p():
        inner = "".join(rng.choice([words(rng.randint(1, 12)), f"<b>{words(2)}</b>", f"<a>{words(2)}</a>", f"<i>{words(1)}<a>{words(1)}</a></i>"]) + " " for _ in range(rng.randint(1, 8)))
        return f"<p>{inner}</p>"

    def div(depth):
        parts = [p() if depth == 0 or rng.random() < 0.5 else div(depth - 1) for _ in range(rng.randint(1, 6))]
        tag = rng.choice(["div", "section"])
        return f"<{tag}>{''.join(parts)}</{tag}>"

    page = f"<html><body>{''.join(div(rng.randint(0, 3)) for _ in range(rng.randint(1, 4)))}</body></html>"
    assert extraction.main_text(page) == plain_density(page)


def test_long_broken_pages_end_soon():
    began = time.process_time()
    for page in ("<span>" * 60_000 + "x" + "</b>" * 60_000, "<b><div>" + "<span>" * 60_000 + "</b>" * 60_000, "<p>" + "<button>" * 30_000 + "</p>" * 30_000, '<a ">' * 100_000, "<a '>x" * 60_000, "<div class='x'>" * 40_000 + "</i>" * 40_000, "<p>x</p>" * 60_000, "<article><p>" + "<![x" * 100_000, "<li>" * 60_000 + "</dd>" * 60_000):
        extraction.main_text(page)
    assert time.process_time() - began < 60
    long = "<article>" + "<p>a paragraph of several words</p>" * 100_000 + "</article>"
    assert extraction.main_text(long).count("\n\n") == 99_999


def test_density_picks_the_article_without_names():
    menu = "<div>" + "".join(f"<p><a href=/{i}>entry {i}</a></p>" for i in range(60)) + "</div>"
    body = "<div>" + "".join(f"<p>This is sentence number {i} of the story, which goes on for a while.</p>" for i in range(8)) + "</div>"
    text = extraction.main_text(f"<body>{menu}{body}<div>Imprint</div></body>")
    assert text.startswith("This is sentence number 0") and text.count("\n\n") == 7


PROSE = "A sentence of the article that is long enough to be told from a menu, with some more words to it. "


def test_sections_of_any_size_belong_to_an_article_without_its_tag():
    section = lambda name, n: f"<div class=sec><h2>{name}</h2>" + "".join(f"<p>{name} {i} {PROSE * 3}</p>" for i in range(n)) + "</div>"
    found = extraction.main_text("<body><div id=page>" + section("A", 1) + section("B", 1) + section("C", 2) + "</div></body>")
    assert [b[0] for b in found.split("\n\n")] == list("AABBCCC")
    found = extraction.main_text(f"<section><p>A {PROSE}</p><p>A2 {PROSE}</p></section><section><p>B {PROSE}</p></section>")
    assert [b[:2] for b in found.split("\n\n")] == ["A ", "A2", "B "]
    columns = f"<div class=row><div><h1>Title</h1><p>one {PROSE}</p><p>two {PROSE}</p></div><div>" + "".join(f"<p>more {i} {PROSE * 2}</p>" for i in range(4)) + "</div></div>"
    assert [b.split()[0] for b in extraction.main_text(f"<body>{columns}</body>").split("\n\n")] == ["Title", "one", "two", *["more"] * 4]
    above = f"<body><div id=page><h1>Title</h1><div class=text><p>one {PROSE}</p><p>two {PROSE}</p></div><p>&copy; 2020</p></div></body>"
    assert [b.split()[0] for b in extraction.main_text(above).split("\n\n")] == ["Title", "one", "two"]


def test_generated_pages_without_article_elements():
    """Recall and precision of blocks over layouts of all kinds: nested, sections, columns, with menus, notices and adverts around and between."""
    rng = random.Random(8)
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta of the and with from more words here told again".split()) for _ in range(n))
    hits = told = true = 0
    for page in range(150):
        want = []

        def para(low=12, high=90):
            want.append(words(rng.randrange(low, high)))
            return rng.choice(["<p>{}</p>", "<p><b>{}</b></p>", "<p>{}<br></p>"]).format(want[-1])

        def head():
            want.append(f"heading {words(3)}")
            return f"<h2>{want[-1]}</h2>"

        def link_list():
            return "<ul>" + "".join(f"<li><a href=/{i}>{words(2)}</a></li>" for i in range(rng.randrange(3, 9))) + "</ul>"

        kind = page % 4
        if kind == 0:
            body = "<div class=text>" + head() + "".join(para() for _ in range(rng.randrange(2, 9))) + "</div>"
        elif kind == 1:
            body = "".join("<section>" + head() + "".join(para() for _ in range(rng.randrange(1, 4))) + "</section>" for _ in range(rng.randrange(2, 5)))
        elif kind == 2:
            body = "<div><div>" + head() + para() + para() + "</div><div>" + "".join(para() for _ in range(3)) + "</div></div>"
        else:
            body = "<div>" + head() + para() + "<div class=inner><blockquote>" + para() + "</blockquote>" + para() + "</div>" + para() + "</div>"
        around = [f"<div class=x{i}>{link_list()}</div>" for i in range(2)] + [f'<div class="ad">{words(8)}</div>', f"<footer>{words(12)}</footer>", f"<nav>{link_list()}</nav>", f'<div class="cookie-notice">{words(20)}</div>', f"<div>&copy; {words(2)}</div>"]
        rng.shuffle(around)
        cut = rng.randrange(len(around))
        html = f"<html><body><div id=all>{''.join(around[:cut])}<div id=page>{body}</div>{''.join(around[cut:])}</div></body></html>"
        found = extraction.main_text(html).split("\n\n")
        hits += len(set(found) & set(want))
        told += len(found)
        true += len(want)
    assert hits / true >= 0.95 and hits / told >= 0.95, (hits / true, hits / told)
