import pytest

from diffmill.llm import wrappers as W

PAGE = """<!DOCTYPE html><html lang="en"><head><title>No</title><style>p{{}}</style><script>var t="</p>";</script></head>
<body class="with-sidebar"><header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li><li>B</li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="ad-7">Buy &amp; buy</div>
<article class="post"><header><h1>The  title
of {0}</h1></header><p>First <b>bold</b> &lt;word&gt; &eacute;&#233;&amp;amp;<p>Second<br>line
<div class="share">Tweet</div><ul><li>One<li>Two</ul><form><label>Mail</label><input></form><aside>Side</aside>
<figure><figcaption>Caption</figcaption></figure><pre>a
  b</pre><section class="comments"><p>Nice!</p></section></article>
<aside>More</aside><footer><p>&copy; us</p></footer></body></html>"""
TEXT = "The title of {0}\nFirst bold <word> éé&amp;\nSecond\nline\nOne\nTwo\nCaption\na b"


def test_marked_article():
    assert W.article_text(PAGE.format(1), None, None) == TEXT.format(1)


@pytest.mark.parametrize("source, text", [
    (None, ""), ("", ""), (" \n", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("<p>a &am", "a &am"), ("a<b", "a"), ("a < b", "a < b"),
    ("<p>x<script>never closed", "x"), ("<div><p>a</div>b", "a\nb"), ("<!-- c <p>no</p> --><p>yes", "yes"), ("<p title='>'>a</p>", "a"),
    ("<article>t<nav><a>x</article>", "t"), ("<p><a href=x>in</a> link</p>", "in link"), ("</p></div>x", "x"), ("<p>a&nbsp; b</p>", "a b"),
    ("<article><p>a<span class=ad>buy</span>b</p></article>", "a\nb"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
    ("<p>" + "<b>" * 3000 + "deep", "deep"), ("x" * 10**6, "x" * 10**6), ("<p>" + "a<br>" * 20000, "\n".join(["a"] * 20000)),
])
def test_broken_and_awkward_pages(source, text):
    assert W.article_text(source, None, None) == text


def fold(text):
    return W.written(W.folded(text.split()))


def test_repeats_fold_into_groups():
    assert fold("ul li # li # li #") == "ul (li #)+"
    assert fold("a a a b") == "a+ b"
    assert fold("x a b a b y a b a b y") == "x ((a b)+ y)+"
    assert fold("a b c") == "a b c"


def test_alignment_gives_optional_and_repeated_groups():
    a, b = W.folded("h p # p # f".split()), W.folded("h p # f".split())
    assert W.written(W.aligned(a, b)) == "h (p #)+ f"
    assert W.written(W.aligned(W.folded("h x f".split()), W.folded("h f".split()))) == "h x? f"
    assert W.written(W.aligned(W.folded("h x f".split()), W.folded("h y f".split()))) in ("h x? y? f", "h y? x? f")
    assert W._unpacked(W._packed(a)) == a


def matches(parts, tokens):
    """Whether the expression generates the tokens."""
    ends = {0}
    for part, repeated, optional in parts:
        def once(starts, part=part):
            if isinstance(part, str):
                return {i + 1 for i in starts if i < len(tokens) and tokens[i] == part}
            out = set()
            for i in starts:
                out |= {i + e for e in all_ends(list(part), tokens[i:])}
            return out

        found, new = (set(ends) if optional else set()), once(ends)
        while new - found:
            found |= new
            new = once(new) if repeated else set()
        ends = found
    return ends


all_ends = matches


def test_wrappers_generate_their_pages():
    import random

    rng = random.Random(2)
    for _ in range(100):
        pages = [("h " + "p # " * rng.randrange(4) + "x " * rng.randrange(2) + "li # " * rng.randrange(3) + "f").split() for _ in range(4)]
        wrapper = W.folded(pages[0])
        for p in pages[1:]:
            wrapper = W.aligned(wrapper, W.folded(p))
        for p in pages:
            assert len(p) in matches(wrapper, p), (W.written(wrapper), p)


def site(n, body):
    return [(i, f"http://{body[0]}/p{i}", body[1].format(i)) for i in range(n)]


PLAIN = "<body><div class=top><a href=/>Home</a> <a>News</a></div><div class=wrap><div class=body><p>Words of page {0} go on and on</p><p>And more of {0}</p></div></div></body>"


def test_hosts_without_marks_use_the_container_of_most_text(spark):
    rows = site(12, ("a.org", PAGE)) + [(100 + i, u, h) for i, u, h in site(8, ("b.org", PLAIN))]
    rows += [(200, "http://b.org/x", "<body><p>Other layout</p></body>"), (201, None, "<p>no host"), (202, None, None), (202, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", W.F.lit(1)).withColumn("host", W.F.lit(2))
    got = W.extract_articles(pages).collect()
    found = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert all(found[i] == TEXT.format(i) for i in range(12))
    assert all(found[100 + i] == f"Words of page {i} go on and on\nAnd more of {i}" for i in range(8))
    assert found[200] == "Other layout" and found[201] == "no host" and found[202] == ""
    wrapper = next(r.wrapper for r in got if r.page_id == 0)
    assert "article" in wrapper and "|" not in wrapper


def test_empty_table(spark):
    assert W.extract_articles(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_texts_that_the_wrapper_shows_to_be_template_are_left_out(spark):
    """An unmarked notice and a box inside the article, one of them in the same repeated group as the paragraphs."""
    import random

    rng = random.Random(8)

    def page(i):
        own = "".join(f"<p>Own text {i} {k}</p>" for k in range(rng.randrange(1, 6)))
        box = "<section class=x><h2>More from us</h2><ul><li>Shop<li>Team</ul></section>" if i % 2 else ""
        return f"<body><article><h1>Title {i}</h1>{own}<p>All rights are ours.</p>{box}</article></body>"

    rows = [(i, "http://c.org/x", page(i)) for i in range(60)] + [(100 + i, "http://d.org/x", page(0)) for i in range(30)]
    rows += [(200 + i, "http://e.org/x", page(i)) for i in range(5)]
    found = {r.page_id: r.text.split("\n") for r in W.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(60):
        assert found[i][0] == f"Title {i}" and len(found[i]) > 1
        assert all(x.startswith("Own text") for x in found[i][1:])
    assert all(found[100 + i][-1] == "All rights are ours." for i in range(30))  # one page thirty times shows no template
    assert all("All rights are ours." in found[200 + i] for i in range(5))


@pytest.mark.parametrize("n", [5, 19, 20, 40])
def test_headings_that_every_page_has_stay_between_its_texts(spark, n):
    def page(i):
        parts = [f"<h1>Dish {i}</h1>", "<h2>Ingredients</h2>", f"<p>{i} eggs</p>", "<h2>Method</h2>", f"<p>Stir {i} times</p>"]
        return f"<body><nav>Menu</nav><article>{''.join(parts)}</article><footer>End</footer></body>"

    rows = [(i, "http://h.org/x", page(i)) for i in range(n)]
    found = {r.page_id: r.text for r in W.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: f"Dish {i}\nIngredients\n{i} eggs\nMethod\nStir {i} times" for i in range(n)}


def test_slots_are_places_in_the_wrapper():
    a, b = W.Page("<p>a<p>b<div>x</div><p>c"), W.Page("<p>a<div>y</div>")
    wrapper = W._packed(W.aligned(W.folded(a.layout), W.folded(b.layout)))
    first, second = W.slots(a, wrapper), W.slots(b, wrapper)
    assert first[0] == first[1] == second[0] and first[2] == second[1] and first[3] not in first[:3]
    assert W.slots(W.Page("<table><tr><td>x"), wrapper) == ["/table/tr/td"]


LONG = "Text of the article that goes on for some time"


@pytest.mark.parametrize("source, text", [
    (f"<div class='content no-sidebar'><article>{LONG}</article></div>", LONG),
    (f"<div class='has-search'><main><p>{LONG}</main></div>", LONG), (f"<section id='notice-of-award'><p>{LONG}</section>", LONG),
    (f"<div class=social><p>Us</p><article>{LONG}<div class=share>Tweet</div></article></div>", LONG),
    (f"<article>{LONG}</article><div class=sidebar><article>Teaser</article></div>", LONG),
    (f"<article>{LONG}<section class=comments><article>{LONG} {LONG}</article></section></article>", LONG),
    (f"<div class=body>{LONG}</div><div class=sidebar><article>Teaser</article></div>", LONG),
    (f"<article>{LONG}<math><mi>x</mi></math><object>y</object></article>", f"{LONG}\nx\ny"),
    *[(f"<article>{LONG}<div class='{c}'>no</div></article>", LONG) for c in ("comments-area", "post relatedPosts", "cookie_notice", "ad-7", "sidebar__inner")],
    *[(f"<article>{LONG}<div class='{c}'>yes</div></article>", f"{LONG}\nyes") for c in ("ad-free", "search-engines", "without-comments")],
])
def test_marks_are_whole_names_or_head_words_and_do_not_hide_the_article(source, text):
    assert W.article_text(source, None, None) == text


def test_a_mark_around_all_text_of_a_host(spark):
    rows = [(i, "http://f.org/x", f"<body><nav>Menu</nav><section id=notice><p>{LONG} {i}</p></section></body>") for i in range(3)]
    rows += [(10, "http://g.org/x", f"<body><p>{LONG}</p></body>"), (11, "http://g.org/y", "<body><div class=notice>Hm</div></body>")]
    found = {r.page_id: r.text for r in W.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {0: f"{LONG} 0", 1: f"{LONG} 1", 2: f"{LONG} 2", 10: LONG, 11: ""}
