import html as entities
import json
import re

from quireframe.llm.contract import op1_html
from quireframe.llm.html import Learner, Wrapper, extract, merge_wrappers, pairs, parse


def plain(page):
    """The text of the test pages' article element, by patterns."""
    article = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
    return "\n\n".join(b for b in blocks if b)


def test_query(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op1_html(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain(pages[r.page_id].html), len(r.text))


def learnt(*pages):
    learner = Learner()
    for p in pages:
        learner.add("h", p)
    return json.loads(learner.take()[0][1])


def test_alignment():
    assert pairs(list("axbc"), list("abyc")) == [(0, 0), (1, None), (2, 1), (None, 2), (3, 3)]
    assert pairs([], ["a"]) == [(None, 0)]


def test_wrapper_has_repeats_options_and_slots():
    w = learnt("<ul><li>a<li>b</ul><p>same<div>x</div>", "<ul><li>c</ul><p>same", "<ul><li>d<li>e<li>f</ul><p>same")
    (ul, _, li), p, div = w["items"]
    assert (ul, li[0][0], p[0], div[0]) == ("ul", "li", "p", "div")
    assert li[0][2][0][4] == [] and len(p[2][0][4]) == 1 and div[1] & 1 and not p[1] & 1
    dl = learnt("<dl><dt>a<dd>b<dd>B<dt>c<dd>d<dt>e<dd>f</dl>")["items"][0][2]
    assert any(x[0] == "" and x[1] & 2 for x in dl)


def test_merging_is_the_same_in_parts():
    pages = [f"<div class=c><h1>t{i}</h1><p>text {i}" + "<p>more" * (i % 3) + "<div class=end>bye</div></div>" for i in range(9)]
    assert merge_wrappers(learnt(*pages[:4]), learnt(*pages[4:])) == learnt(*pages)


def site(i):
    return (
        f"<html><head><title>no</title></head><body class='has-sidebar'><div id=top class=site-header><a href=/>Home</a></div><div id=nav-menu><ul><li>A<li>B</ul></div>"
        f"<div class=content><h1>Title {i}</h1><p>Para {i} &amp; one, long\n enough <a href=x>link</a> here.<p>Second para {i} with more text that goes on"
        f"<div class=ad-slot>Buy {i}</div><p>Third {i}</p><div>Share this page</div></div><div class=sidebar>side {i}</div>"
        f"<section id=comments><h2>Comments</h2><p>first! {i} a very long comment, longer than the article itself is, by a reader who {i} has much to say</p></section>"
        f"<div class=cookie-notice>We use cookies {i}</div><footer>foot {i}</footer><form><label>Name</label></form><script>var x = '<p>no</p>';</script></body>"
    )


def test_pages_without_an_article_element():
    w = Wrapper(learnt(*map(site, range(5))))
    for i in range(5):
        assert w.text(site(i)) == f"Title {i}\n\nPara {i} & one, long enough link here.\n\nSecond para {i} with more text that goes on\n\nThird {i}"


def test_near_copies_keep_their_text():
    pages = [f"<article><h1>T</h1><p>the same long paragraph<p>and the same second one<p>but {i}</article>" for i in range(6)]
    assert Wrapper(learnt(*pages)).text(pages[2]) == "T\n\nthe same long paragraph\n\nand the same second one\n\nbut 2"


def test_broken_markup():
    assert parse("<p>a<b>c</p>d<div>e") == ((("p", ("#",)), "#", ("div", ("#",))), [[(0, "ac", 0)], [(1, "d", 0)], [(2, "e", 0)]])
    for page in ("<div>" * 50000 + "x", '<a href="x ' * 50000, "<p>hi" * 5000, "<" * 50000, "<!--" * 50000, "<a '" * 50000, "<script>" * 5000, "<a \"'>" * 5000):
        parse(page)


def test_hard_rows(spark):
    rows = [(i, "http://h.example/x", site(i)) for i in range(5)] + [(9, None, "<p>no host"), (10, "odd", "<nav>x</nav>y &lt;z&gt;"), (11, "http://h.example/", None), (12, "http://h.example/", ""), (None, "http://h.example/q", site(1)), (None, "http://h.example/q", site(1))]
    df = spark.createDataFrame([(*r, "w", "h") for r in rows], "page_id long, url string, html string, wrapper string, host string")
    for most in (0, 1 << 20):
        got = extract(df, most).collect()
        text = {r.page_id: r.text for r in got}
        assert len(got) == 11 and text[9] == "no host" and text[10] == "y <z>" and text[11] == text[12] == ""
        assert text[None] == text[1] and text[3].startswith("Title 3\n\nPara 3 & one") and all(r.n_chars == len(r.text) for r in got)
    assert extract(df.limit(0)).count() == 0


def test_tables_as_layout():
    def page(i):
        return (
            f"<table><tr><td><a href=/>Home</a> | <a href=/a>About</a></td></tr><tr><td><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></td><td><h1>Story {i}</h1><p>{'word ' * 30}{i}</p>"
            f"<div class=adsbygoogle>Buy {i}</div><p>more {i}</p></td></tr><tr><td>Copyright 2020</td></tr></table>"
        )

    w = Wrapper(learnt(*map(page, range(6))))
    assert w.text(page(2)) == f"Story 2\n\n{'word ' * 30}2\n\nmore 2"


def article(i, body):
    return f"<html><body><div class=nav><a href=/>Home</a></div><article><h1>Title {i}</h1><p>First paragraph {i} of an article, long enough to read as prose on its own, as articles are.</p>{body}</article><footer>x</footer></body></html>"


PROSE = "a part of the article {i} that goes on for quite some time, so that it reads as prose and not as a row of links or buttons."


def texts(pages):
    w = Wrapper(learnt(*pages))
    return [w.text(p) for p in pages]


def test_parts_of_an_article_stay_whatever_their_class():
    for name in ("discussion", "related-work", "reply-to-critics", "results"):
        pages = [article(i, f"<section class='{name}'><h2>Part {i}</h2><p>{PROSE.format(i=i)}</p></section>") for i in range(4)]
        assert all(f"Part {i}\n\n{PROSE.format(i=i)}" in t for i, t in enumerate(texts(pages)))
    pages = [article(i, f"<div class='related'><a href=1>See {i}</a> <a href=2>More</a></div><section class='comments'><p>{PROSE.format(i=i)}</p></section><div class='notice'>{PROSE.format(i=i)}</div>") for i in range(4)]
    assert not any("See" in t or PROSE.format(i=i) in t for i, t in enumerate(texts(pages)))


def test_linked_references_stay_and_link_rows_go():
    rows = "<ul>" + "".join(f"<li><a href=r{k}>Author {k}, a title of some length, journal {k}</a></li>" for k in range(5)) + "</ul>"
    pages = [article(i, f"{rows}<p><a href=p>Prev</a> <a href=n>Next {i}</a></p>") for i in range(2)]
    for t in texts(pages):
        assert t.count("a title of some length") == 5 and "Next" not in t


def test_template_lines_of_short_articles_go():
    pages = [f"<article><h1>News {i}</h1><p>Short item {i}.</p><p>Subscribe to our letter</p></article>" for i in range(4)]
    assert texts(pages) == [f"News {i}\n\nShort item {i}." for i in range(4)]


def test_deep_marks_and_long_tags():
    for deep in (5, 90, 500):
        page = "<article>" + "<div>" * deep + "<p>Kept text here</p><div class=advert>Buy this</div><p>and more</p>" + "</div>" * deep + "<p>after</p></article>"
        assert texts([page]) == ["Kept text here\n\nand more\n\nafter"]
    many = "".join(f" data-a{k}='v{k}'" for k in range(900))
    assert texts([f"<article><p{many}>plain</p></article>"]) == ["plain"]


def test_long_rows_align_in_linear_time():
    import time

    began = time.process_time()
    a, b = [f"a{i}" for i in range(4000)], [f"b{i}" for i in range(4000)]
    assert len(pairs(a, b)) == 8000
    c = [x for i in range(3000) for x in (f"k{i}", "div")]
    d = [x for i in range(0, 3000, 2) for x in (f"k{i}", "div", "p")]
    assert sum(i is not None and j is not None and c[i] == d[j] for i, j in pairs(c, d)) >= 2900
    assert [i for i, _ in pairs(c, d) if i is not None] == list(range(len(c))) and [j for _, j in pairs(c, d) if j is not None] == list(range(len(d)))
    assert time.process_time() - began < 3
