import pytest

from vecspark.llm import html
from vecspark.llm.html import LABELLED, extract, learned, made, main_text

W = learned()


def wrap(body, **kw):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='</p><article>';</script><style>p{{x:y}}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>{body}<footer>&copy; us</footer></body></html>"


@pytest.mark.parametrize(("source", "text"), LABELLED)
def test_labelled(source, text):
    assert main_text(source, W) == text


def test_weights_hold_on_made_pages_not_learnt_from():
    """Pages of the same rule and another seed, none with a name or a main element: the text is whole, little comes with it."""
    pages = made(400, seed=99)
    found = [main_text(source, W) for source, _ in pages]
    words = sum(len(text.split()) for _, text in pages)
    assert sum(text not in own for own, (_, text) in zip(found, pages, strict=True)) <= 4
    assert sum(max(0, len(own.split()) - len(text.split())) for own, (_, text) in zip(found, pages, strict=True)) < 0.03 * words
    assert all(v > 0 for k, v in W.items() if k in ("word", "main")) and all(v < 0 for k, v in W.items() if k not in ("word", "main"))


ARTICLE = "<article><h1>Title here</h1><p>First para with <b>bold</b>face &amp; more&hellip;</p>{}<p>Last&nbsp;&nbsp;para.</p></article>"
PLAIN = "Title here First para with boldface & more… Last para."


@pytest.mark.parametrize("inner", [
    "", "<script>bad()</script>", "<!-- hidden <p>words</p> -->", "<aside>Side words that go on and on for quite a while here</aside>", "<div class='ad'>Buy now buy now</div>", "<form><label>Mail</label><input><button>Send</button></form>",
    "<div class=\"advert box\"><p>Buy</p></div>", "<div id=cookie-notice>We use cookies</div>", "<section class='related-posts'><h2>Related</h2><a>One</a></section>", "<nav>menu words</nav>", "<style>.a{b:c}</style>", "<div style='display: none'>secret</div>", "<div hidden>secret</div>", "<noscript>turn on</noscript>", "<select><option>1</option></select>",
])
def test_furniture_inside_the_article_goes(inner):
    assert main_text(wrap(ARTICLE.format(inner)), W) == PLAIN


@pytest.mark.parametrize("around", ["<div id=comments><article class=comment><p>I disagree with all of it, every single word.</p></article></div>", "<header><h1>Site name</h1><p>Slogan of the site</p></header>", "<div class=sidebar><p>Long words in the side bar that say nothing about it.</p></div>", "<div class=newsletter-signup>Get our newsletter</div>", "<div role=complementary>Popular now</div>"])
def test_furniture_around_goes(around):
    for body in (around + ARTICLE.format(""), ARTICLE.format("") + around):
        assert main_text(wrap(body), W) == PLAIN


@pytest.mark.parametrize(("source", "text"), [
    (None, ""), ("", ""), ("<p></p>", ""), ("just text", "just text"), ("<article><p>cut of", "cut of"), ("<article><p>a tag is cut <b", "a tag is cut"), ("<article><p>refs &am", "refs &am"), ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    ("<article><header><h1>Head</h1><p>by me</p></header><p>Body words.</p></article>", "Head Body words."), ("<article><p><b>one<br><p>two</p></article>", "one two"), ("<main><ul><li>a<li>b</ul><table><tr><td>c</td><td>d</td></tr></table></main>", "a b c d"), ("<article>x<script>never closed", "x"), ("<article><p>&lt;b&gt; &#65;&#x42;</p></article>", "<b> AB"),
])
def test_broken_and_bare(source, text):
    assert main_text(source, W) == text


@pytest.mark.parametrize("around", ["<div class='content no-sidebar'>{}</div>", "<div id='page' class='has-sidebar'>{}</div>", "<div class='sidebar-right page'>{}</div>", "<div class='post-content widget-page'>{}</div>", "<div class=ad-free>{}</div>", "<form id=aspnet>{}</form>", "<div class=search-page><div>{}</div></div>", "<div class=sidebar><main>{}</main></div>"])
def test_names_do_not_take_the_article_with_them(around):
    assert main_text(wrap(around.format(ARTICLE.format(""))), W) == PLAIN


@pytest.mark.parametrize("own", ["<article class='post category-ads no-sidebar'>", "<main class=has-comments>", "<div class='content sidebar-left'>"])
def test_main_names_and_elements_win_over_parts_of_names(own):
    name = own[1:].split()[0]
    assert main_text(wrap(f"{own}<h1>Title</h1><p>Words of the text.</p></{name}>"), W) == "Title Words of the text."


@pytest.mark.parametrize("inner", ["<h2 id='privacy'>Kept words</h2>", "<p class='discussion'>Kept words</p>", "<h3 id=related-work>Kept words</h3>", "<blockquote class=notice>Kept words</blockquote>"])
def test_prose_of_the_article_is_kept_whatever_its_name(inner):
    assert main_text(wrap(ARTICLE.format(inner)), W) == PLAIN.replace("Last", "Kept words Last")


@pytest.mark.parametrize("inner", ["<h3 class=hidden-x hidden>gone</h3>", "<p class=advert>gone</p>", "<div class=post-comments>gone</div>", "<section class=comments-section><article><p>gone</p></article></section>", "<div class=entry-share>gone</div>"])
def test_furniture_by_name_still_goes(inner):
    assert main_text(wrap(ARTICLE.format(inner)), W) == PLAIN


@pytest.mark.parametrize("head", ["<head><title>T</title>", "<head><title>T</title><meta charset=x><script>a()</script><link rel=x>", "<head><title>never closed", "<head><noscript><style>p{}</style></noscript><title>T</title>"])
@pytest.mark.parametrize("body", ["<body>{}", "{}", "<body><div>{}</div></body></html>"])
def test_a_head_ends_without_its_end_tag(head, body):
    assert main_text(f"<html>{head}{body.format(ARTICLE.format(''))}", W) == PLAIN


@pytest.mark.parametrize("tag", ["select", "object", "svg", "noscript", "iframe", "video", "math", "template", "canvas", "audio", "datalist"])
def test_inert_elements_take_only_their_own_content(tag):
    for inner in (f"<{tag} a=b>", f"<{tag} a=b><p>", f"</{tag}>", f"<{tag} a=b>gone</{tag}>", f"<{tag}><p>gone</p></{tag}>", f"<{tag} a=b><{tag}>gone</{tag}>"):
        assert main_text(wrap(ARTICLE.format(inner)), W) == PLAIN
    assert main_text(wrap(f"<{tag}><div>gone</div></{tag}>" + ARTICLE.format("") + f"<div><{tag}>"), W) == PLAIN
    assert main_text(wrap("<div class=ad><p>Buy now<" + tag + ">x</" + tag + "> and here</div>" + ARTICLE.format("")), W) == PLAIN


WORDY = "<h1>Title here</h1><p>First para with words and some more of them to read.</p><p>Last para.</p>"
WORDY_TEXT = "Title here First para with words and some more of them to read. Last para."


@pytest.mark.parametrize("around", [
    "<article class='post-discussion'>{}</article>", "<div class='article privacy-policy'>{}</div>", "<main><section class='popular-science'>{}</section></main>", "<main><div class='widget'>{}</div></main>", "<div class='sidebar'>{}</div>",
    "<div class='social-science'><div class='search-form-results'><div class='post-reply'>{}</div></div></div>", "<div><div id=login-page><div class=text>{}</div></div></div>", "<table class='menu-layout content-table'><tr><td>{}</td></tr></table>", "<section id='cookie-recipes'>{}</section>",
    "<svg class=i/><div>{}</div>", "<div class=share-of-voice>{}<div class=ad>Buy now!</div></div>",
])
def test_a_text_is_never_lost_by_the_name_around_it(around):
    for page in (wrap(around.format(WORDY)), f"<html><head><title>T</title><body>{around.format(WORDY)}", around.format(WORDY)):
        assert main_text(page, W) == WORDY_TEXT


@pytest.mark.parametrize("kind", ["comments", "comment-list", "sidebar", "ad", "related-posts", "newsletter-box", "post-comments"])
def test_long_furniture_beside_a_text_still_goes(kind):
    """Without <article> and <main>, too: the text is named or shorter than the rest by less than the shares."""
    extra = f"<div class='{kind}'>" + "<p>Other words that go on for a long while and say nothing of it.</p>" * 4 + "</div>"
    for text in (f"<article>{WORDY}</article>", f"<main>{WORDY}</main>", f"<div class=post-body>{WORDY}</div>"):
        assert main_text(wrap(text + extra), W) == WORDY_TEXT
        assert main_text(wrap(extra + text), W) == WORDY_TEXT
    assert main_text(wrap(f"<div><div>{WORDY * 2}</div></div>" + extra), W) == f"{WORDY_TEXT} {WORDY_TEXT}"


def test_nested_names_are_surveyed_in_three_passes():
    deep = "<div class=sidebar-x>" * 5000 + WORDY
    assert main_text(deep, W) == WORDY_TEXT


def test_linear_in_unclosed_elements():
    for piece in ("<select>", "<svg>", "</svg>", "<head>", "<title>", "<object><p>", "<noscript></div>"):
        main_text(piece * 20_000, W)


def test_linear_in_hostile_pages():
    for piece in ("<", "<a \"", "<!--", "<script", "&", "<div class='ad'>", "</div>", "<p x=\"'"):
        main_text(piece * 20_000, W)


def test_rows(spark):
    rows = [(1, "u", wrap(ARTICLE.format(""))), (1, "u", wrap(ARTICLE.format(""))), (2, None, None), (None, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = extract(df.selectExpr("*", "'x' as text", "1 as n_chars"))
    assert sorted((repr(r.page_id), r.text, r.n_chars) for r in got.collect()) == sorted([("1", PLAIN, len(PLAIN)), ("1", PLAIN, len(PLAIN)), ("2", "", 0), ("None", "", 0)])
    assert extract(df.limit(0)).count() == 0
    assert got.columns == ["page_id", "url", "text", "n_chars"]


def test_pages_table_keeps_every_article(spark, sf_dir):
    import re
    from html import unescape

    got = {r.page_id: r.text for r in html.op1_page_text(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        own = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(unescape(re.sub(r"<[^>]*(?:>|$)", " ", own)).split())
