"""What is part of an article and what isn't, by names, lengths and places of elements."""

import pytest

from tidewater.llm import html_text

PLAIN = "<html><body><nav>Menu one</nav><article><h1>A title</h1><p>some words of text and more</p></article><footer>foot</footer></body></html>"
WEIGHTS = html_text.weigh(html_text.count_tags(PLAIN * 3))
STORY = " ".join(f"a{k}" for k in range(40))


def page(body: str) -> str:
    return f"<html><body><nav><a href=x>Menu</a></nav>{body}<footer>foot</footer></body></html>"


@pytest.mark.parametrize("name", ["comments", "user-comments", "comment-thread", "userComments", "post-comments", "comment-body", "related-posts", "site-footer", "cookie-notice", "legal-notice"])
@pytest.mark.parametrize("words", [5, 60, 400])
def test_named_blocks_go_whatever_their_length(name, words):
    junk = f"<div class='{name}'>{'junk ' * words}</div>"
    for open_, close in (("<article>", "</article>"), ("<div class=post>", "</div>"), ("<div>", "</div>")):
        for body in (f"{open_}<p>{STORY}</p>{close}{junk}", f"{open_}<p>{STORY}</p>{junk}{close}", f"{junk}{open_}<p>{STORY}</p>{close}"):
            assert html_text.main_text(page(body), WEIGHTS) == STORY


def test_menus_by_name():
    body = f"<ul class='site-nav'><li>one two three</li><li>four five six</li></ul><div><p>{STORY}</p></div><div class='site-footer'>imprint and more words</div>"
    assert html_text.main_text(page(body), WEIGHTS) == STORY


@pytest.mark.parametrize("tag", ["article", "main", "div class='post-content'"])
def test_words_that_tell_nothing_inside_of_content(tag):
    body = f"<{tag}><section class='legal'><p>{STORY}</p></section></{tag.split()[0]}>"
    assert html_text.main_text(page(body), WEIGHTS) == STORY


def test_short_article_beside_a_longer_advert():
    body = f"<div class='ad'>{'buy now ' * 60}</div><article><h1>Four words of title</h1></article>"
    assert html_text.main_text(page(body), WEIGHTS) == "Four words of title"


def test_a_named_element_around_the_first_article_stays():
    assert html_text.main_text(page(f"<div class='sidebar'><article><p>{STORY}</p></article></div>"), WEIGHTS) == STORY
    nested = f"<article><p>{STORY}</p><section class='comments'><article><p>{'reader ' * 90}</p></article></section></article>"
    assert html_text.main_text(page(nested), WEIGHTS) == STORY
    apart = f"<article><p>{STORY}</p></article><article class='comment'><p>{'reader ' * 90}</p></article>"
    assert html_text.main_text(page(apart), WEIGHTS) == STORY


@pytest.mark.parametrize("inline", ["<svg><title>x</title></svg>", "<math><mi>y</mi></math>", "<button>Go</button>", "<select><option>a</select>", "<script>var a</script>", "<span class=ad>Buy</span>"])
def test_inline_elements_that_go_do_not_end_a_block(inline):
    assert html_text.main_text(page(f"<article><p>{STORY} {inline} after</p></article>"), WEIGHTS) == f"{STORY} after"


def test_names_of_labelled_pages_cost():
    labelled = PLAIN.replace("<footer>", "<div class='zq-strip'>words of a strip</div><footer>")
    weights = html_text.weigh(html_text.count_tags(labelled * 5))
    assert weights["<@zq"] < 0 and weights["<@strip"] < 0
    strip = "".join(f"<div class='zq-strip'>{'strip ' * 12}</div>" for _ in range(2))
    assert html_text.main_text(page(f"<div><p>{STORY}</p></div>{strip}"), weights) == STORY


@pytest.mark.parametrize("label,want", [("side-by-side", 0), ("no-sidebar", 0), ("content-with-sidebar", 0), ("post-header", 0), ("site-header", -1), ("main-content", 1), ("post-42", 1), ("", 0), ("---", 0), ("Ads", -1)])
def test_names(label, want):
    assert html_text.speaks(label)[0] == want


def test_odd_pages(spark):
    huge = "<article><p>" + "word " * 300_000 + "</p></article>"
    deep = "<div class='ad'>" * 20_000 + "x" + "</div>" * 20_000
    rows = [(1, "u", None, "t"), (2, "u", "", "t"), (3, "u", huge, None), (3, "u", huge, None), (4, "u", deep, "t"), (5, None, page(f"<article>{STORY}</article>"), "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract_text(df, html_text.fit_weights(df))
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    by_id = {(r.page_id, r.text[:2], r.n_chars) for r in got.collect()}
    assert by_id == {(1, "", 0), (2, "", 0), (3, "wo", 1_499_999), (4, "", 0), (5, "a0", len(STORY))} and got.count() == 6
    assert html_text.extract_text(df.limit(0), html_text.fit_weights(df.limit(0))).count() == 0
