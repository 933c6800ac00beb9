"""Pages that are wrapped in what looks like an aside, attribute values with markup in them, and the limit of shared lines at every size of a host."""

import pytest

from lumbre.llm import main_text, quality_rules

COSTS = {t: 0.05 for t in "p h1 b br a".split()}
ARTICLE = '<article><h1>Title here</h1><p>' + "word " * 80 + '</p><p id="comment-on-law">law text here now</p><p><a title="a > b" href="x">linked</a> more words.</p></article>'
WANT = "Title here\n" + ("word " * 80).strip() + "\nlaw text here now\nlinked more words."
NAV, FOOT = "<nav><a>Home</a> <a>About us</a></nav>", "<footer>copyright words</footer>"
COMMENTS = "<section id='comments'><p>nice post I liked it</p><p>me too</p></section>"


@pytest.mark.parametrize(
    "page",
    [
        f"{NAV}{ARTICLE}{FOOT}",
        f"<form action=x>{NAV}{ARTICLE}<input><button>Send it</button></form>{FOOT}",
        f"<form id='aspnetForm'>{NAV}{ARTICLE}{FOOT}</form>",
        f"{NAV}<div class=\"post no-sidebar\">{ARTICLE}</div>{FOOT}",
        f"<div id='banner'>{NAV}<div class=sidebar>{ARTICLE}</div></div>{FOOT}",
        f"<aside>Related links<div>{NAV}{ARTICLE}{FOOT}",
        f"{NAV}<div class='ad-slot'>buy now buy now</div>{ARTICLE}{COMMENTS}{FOOT}",
        f"{NAV}<div class='site-header'>A site</div>{ARTICLE}<div class='cookie-notice'>We use some</div>{FOOT}",
        f"{NAV}<p don't>{ARTICLE}{FOOT}",
        f"{NAV}<img alt='1 > 0' data-x=\"<b>\">{ARTICLE}{FOOT}",
    ],
)
def test_the_article_is_found_in_any_wrapping(page):
    assert main_text.main_text(f"<html><body class='has-sidebar'>{page}</body></html>", COSTS) == WANT


def test_names_of_asides():
    asides = "ad ad-slot adslot-9 left-sidebar main-nav comment-list cookie-banner comments site_footer ad-box-2".split()
    others = "no-sidebar comment-on-law has-header post without-comments comments-disabled-post header-photo-story address".split()
    assert [n for n in asides if not main_text._names_an_aside(n)] == ["adslot-9"]
    assert [n for n in others if main_text._names_an_aside(n)] == []


def test_a_broken_tag_is_read_in_linear_time():
    page = "<p>" + '<a ' + 'x="y" ' * 5_000 + "no end"
    assert main_text.main_text(page, COSTS) is not None


@pytest.mark.parametrize("size", [20, 400, 3000])
def test_a_shared_line_has_one_verdict_at_every_size_of_the_host(spark, size):
    own = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(k, ("often shared line of the host\n" if k < 10 else "rarely shared line of the host\n" if k < 19 else "") + own(k), "h") for k in range(size)]
    lines = quality_rules.document_lines(spark.createDataFrame(rows, "id long, text string, host string"), "id", "text", "host")
    found = quality_rules.frequent_lines(lines).collect()
    assert [(r["_host"], r["_first"]) for r in found] == [("h", 0)]
