import html as entities
import random
import re
import time

from pyspark.sql import functions as F

from benchloom.llm import html, queries

BODY = "<h1>A  title &amp; more</h1><p>First paragraph with <b>bold</b>, a<i>b</i> and &lt;tag&gt;.</p><p>Second one goes on for a while,\n with words&nbsp;and more words here.</p><ul><li>One item</li><li>Two items</li></ul>"
TEXT = "A title & more\nFirst paragraph with bold, ab and <tag>.\nSecond one goes on for a while, with words and more words here.\nOne item\nTwo items"
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>'
FOOT = "<footer>&copy; someone, all rights reserved by the company</footer>"


def page(main, before=NAV, after=FOOT):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body>{before}{main}{after}</body></html>"


PAGES = {
    page(f"<article>{BODY}</article>"): TEXT,
    page(f"<main>{BODY}</main>"): TEXT,
    page(f'<div id="content" class="post">{BODY}</div>'): TEXT,
    page(f"<div>{BODY}</div>"): TEXT,
    page(f'<article>{BODY}<div class="ad">Buy this now for little money today</div><p>Last words.</p></article>'): TEXT + "\nLast words.",
    page(f'<div class="cookie-notice">We use cookies to make the site better for you, accept them</div><article>{BODY}</article><section class="comments"><p>Great article, thanks a lot to the author</p></section>'): TEXT,
    page(f'<header><h1>Site name</h1><p>A site about all the things we like</p></header><article>{BODY}</article><aside><p>Read these other things too, they are good</p></aside>'): TEXT,
    page(f"<form><input name=q><label>Search all of our pages</label></form><article>{BODY}</article>"): TEXT,
    page(f"<article>{BODY}<script>if (a < b) document.write('<p>x</p>')</script><!-- <p>not shown</p> --></article>"): TEXT,
    page("<article><p><b>Never closed<br><p>Next one is here</article>"): "Never closed\nNext one is here",
}


def test_templates():
    for source, text in PAGES.items():
        assert html.extract(source, html.Weights()) == text, source


def test_broken_pages():
    for source in ("", " ", "<", "<p", "<!-- x", "<script>x", "</div></p>", "<p>one two three", "a & b &am &amp c" * 3, "<b>" * 2000, "<div class='" + "x" * 10000):
        html.extract(source, html.Weights())
    assert html.extract("<p>one two three four", html.Weights()) == "one two three four"


def articles(rows):
    """Main texts of the synthetic pages by brute force: all of their only article."""
    out = {}
    for r in rows:
        own = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br)>", own)
        lines = (" ".join(entities.unescape(re.sub(r"</?b>", "", b)).split()) for b in blocks)
        out[r.page_id] = "\n".join(x for x in lines if x)
    return out


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/pages.parquet").collect()
    got = {r.page_id: r.text for r in queries.op8_html(spark, d).collect()}
    assert got == articles(rows)


def test_nulls_and_other_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, page(f"<article>{BODY}</article>"), "x")], "page_id long, html string, main_text string")
    got = {r.page_id: r.main_text for r in html.main_text(df).collect()}
    assert got == {1: "", 2: "", None: TEXT}
    assert html.main_text(df.filter(F.lit(False))).count() == 0


def test_long_tags():
    uri = '<img src="data:image/png;base64,' + "QUJD" * 25_000 + '">'
    many = " ".join(f'data-a{i}="v > {i}"' for i in range(500))
    style = "color:red;" * 2000
    for long in (f"<article>{uri}{BODY}</article>", f"<article {many}>{BODY}</article>", f"<article style='{style}'>{BODY}</article>", f"<article><script {many}>var a = 'seen as text';</script>{BODY}</article>"):
        assert html.extract(page(long), html.Weights()) == TEXT
    assert [e[:2] for e in html.events("a <b 'x <i>y</i>")] == [("text", "a <b 'x "), ("open", "i"), ("text", "y"), ("close", "i")]


def test_tags_without_end_take_linear_time():
    start = time.process_time()
    for part in ("<a ", "<a", "<a '", "<a \"' ", "<a '\" x"):
        for end in ("", ">", "'", '"', "' >", "\" '>"):
            list(html.events(part * 30_000 + end))
    assert time.process_time() - start < 20


def test_tags_in_an_article_cut_nothing():
    spans = "<span></span>" * 60
    rows = "".join(f"<tr><td></td><td>{i}</td><td></td><td></td><td></td><td></td></tr>" for i in range(40))
    table = f"<table>{rows}</table>"
    last = "<p>tail words of article</p>"
    assert html.extract(page(f"<article>{BODY}{spans}{last}</article>"), html.Weights()) == TEXT + "\ntail words of article"
    cells = "\n".join(str(i) for i in range(40))
    assert html.extract(page(f"<article>{BODY}{table}{last}</article>"), html.Weights()) == f"{TEXT}\n{cells}\ntail words of article"
    assert html.extract(page(f'<div class="content">{BODY}{table}{last}</div>'), html.Weights()) == f"{TEXT}\n{cells}\ntail words of article"


def test_names_of_several_words():
    for name in ("legal-news", "search-results-explained", "commentOnLaw", "advertising-history"):
        assert html.extract(page(f'<article>{BODY}<div class="{name}"><p>Words that belong here.</p></div></article>'), html.Weights()) == TEXT + "\nWords that belong here.", name
    for name in ("site-footer", "related-posts", "cookie-notice", "mainNav", "share-buttons", "post-comments", "sidebar-left", "cookie-content"):
        side = f'<div class="{name}"><p>Some words that do not belong to it at all.</p></div>'
        if name != "site-footer":
            assert html.extract(page(f"<article>{BODY}{side}</article>"), html.Weights()) == TEXT, name
    assert html._said(["main", "nav"]) == ["mainnav", "nav"] and html._said(["post", "content", "wrapper"])[1] == "content"


def test_best_run_against_all_runs():
    rng = random.Random(5)
    for _ in range(300):
        scores = [rng.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(rng.randint(0, 25))]
        low, high = html.best_run(scores)
        best = max((sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0)
        assert abs(sum(scores[low:high]) - max(best, 0)) < 1e-9


def test_deep_pages_take_linear_time():
    start = time.process_time()
    for part in ("<div>", "<p>", "<b>x", "<li>x", "<span><option>", "</div>", "<dd><i>", "<table><td>"):
        html.extract(part * 20_000, html.Weights())
    assert time.process_time() - start < 20


FORTY = " ".join(f"word{i}" for i in range(40))
ITEMS = "".join(f"<li>item{i}</li>" for i in range(40))
ITEM_TEXT = "\n".join(f"item{i}" for i in range(40))
MENU = "<ul>" + "".join(f'<li><a href="/{i}">place{i}</a></li>' for i in range(8)) + "</ul>"

#: Pages of other shapes than the tables have, and their main texts.
SHAPES = {
    page(f"<article><h1>Title</h1><div><p>{FORTY}</p></div></article>"): f"Title\n{FORTY}",
    page(f"<article><h1>Title</h1><ul><li>{FORTY}</li></ul><p>x</p></article>"): f"Title\n{FORTY}\nx",
    page(f"<article>{FORTY}</article>"): FORTY,
    page(f"<div><h1>Title</h1><p>{FORTY}</p></div>"): f"Title\n{FORTY}",
    page(f"<div><h1>Title</h1><p>{FORTY}</p></div>", "", ""): f"Title\n{FORTY}",
    page(f"<h1>Title</h1><p>{FORTY}</p><ul>{ITEMS}</ul><p>after the list</p>"): f"Title\n{FORTY}\n{ITEM_TEXT}\nafter the list",
    page(f"<ul>{ITEMS}</ul><p>after the list</p>", "", ""): f"{ITEM_TEXT}\nafter the list",
    page(f"<article><p>{FORTY}</p></article><div>{'between ' * 240}</div><article><p>second one</p></article>".replace("between " * 240, "between " * 60)): f"{FORTY}\nsecond one",
    page(f"<article><p>{FORTY}</p></article><div>{'between ' * 240}</div><article><p>{'more ' * 90}</p></article>"): f"{FORTY}\n{('more ' * 90).strip()}",
    page(f"<article><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>{FORTY}</td></tr></table></article>"): f"a\nb\n1\n{FORTY}",
    page(f"<section><section><section><h2>Deep</h2><div><div><p>{FORTY}</p></div></div></section></section></section>"): f"Deep\n{FORTY}",
    page(f"<main><section><h2>One</h2><p>{FORTY}</p></section><section><h2>Two</h2><dl><dt>term</dt><dd>meaning</dd></dl></section></main>"): f"One\n{FORTY}\nTwo\nterm\nmeaning",
    page(f'{MENU}<div class="x1"><h1><a href="/t">Linked title</a></h1><p>{FORTY}</p></div>{MENU}'): f"Linked title\n{FORTY}",
    page(f"<div><p>{FORTY}</p>{MENU}<p>{FORTY}</p></div>"): FORTY + "\n" + "\n".join(f"place{i}" for i in range(8)) + "\n" + FORTY,
    page(f'<article class="card"><p>Tiny teaser</p></article><div><h1>Title</h1><p>{FORTY} {FORTY}</p></div>'): f"Tiny teaser\nTitle\n{FORTY} {FORTY}",
    page(f"<article><blockquote><p>quoted</p></blockquote><pre>{FORTY}</pre><figure><figcaption>caption</figcaption></figure></article>"): f"quoted\n{FORTY}\ncaption",
    page(f"<article><header><h1>Title</h1></header><div><ul><li><a href='/r'>{FORTY}</a></li></ul></div></article>"): f"Title\n{FORTY}",
    page(f'<div role="main"><div><p>{FORTY}</p></div><aside>{FORTY}</aside></div>'): FORTY,
}


def fitted(spark, pages):
    return html.fit(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"))


def test_other_shapes_with_learned_weights(spark):
    rows = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    for weights in (html.Weights(), fitted(spark, rows), fitted(spark, rows[::2]), fitted(spark, rows[1:3]), fitted(spark, [*rows[:100], *SHAPES])):
        for source, text in {**SHAPES, **PAGES}.items():
            assert html.extract(source, weights) == text, source


def test_shapes_against_all_runs_of_the_stated_score(spark):
    rows = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").limit(20).collect()]
    weights = fitted(spark, rows)
    for source in [*SHAPES, *PAGES, *rows[:5]]:
        tokens = html.scored(source, weights)
        before = [0.0]
        for t in tokens:
            before.append(before[-1] + t.score)
        best = max((before[b] - before[a] for a in range(len(tokens)) for b in range(a + 1, len(tokens) + 1)), default=0.0)
        low, high = html.best_run([t.score for t in tokens])
        assert abs(before[high] - before[low] - max(best, 0.0)) < 1e-9
        assert html.extract(source, weights) == html.text_of(tokens[low:high])


def test_names_learned_from_labelled_pages_help_pages_without_marks(spark):
    side, body = f'<div class="zq">{"Join us " * 15}</div>', f'<div class="yk"><p>{FORTY}</p></div>'
    labelled = [page(f"{side}<main>{body}</main>", before="", after="") for _ in range(6)]
    bare = page(side + body + side, before="", after="")
    learned = fitted(spark, labelled)
    assert html.extract(bare, html.Weights()) != FORTY and html.extract(bare, learned) == FORTY
    wrapped = page(f'<div class="widget"><div><p>{FORTY}</p></div></div>', before="", after="")
    assert html.extract(wrapped, html.Weights()) == ""
    assert html.extract(wrapped, fitted(spark, [page(f'<div class="widget"><main><p>{FORTY}</p></main></div>') + " " * i for i in range(30)])) == FORTY
