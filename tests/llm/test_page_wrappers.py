"""Names on wrappers don't cost a page its article."""

import pytest

from ledgerlake.llm import html_main

KEPT = "First words.\nMore of them."
BODY = "<p>First words.</p><p>More of them.</p>"


@pytest.mark.parametrize("page", [
    f'<form id="aspnetForm"><article>{BODY}</article></form>',
    f'<div class="site has-sidebar"><article>{BODY}</article><div class="sidebar">menu</div></div>',
    f'<div id="page" class="page-header-sticky"><main>{BODY}</main></div>',
    f'<div class="content with-comments">{BODY}</div>',
    f'<h2 class="no-share">First words.</h2><div class="has-ads"><p>More of them.</p><div class="ads">buy</div></div>',
    f'<form><div class="header-fixed header"><form><article>{BODY}<div class="share">share</div></article></form></div></form>',
    f'<div class="search">{BODY}<form><input value="x"><label>find</label></form></div>',
])
def test_a_wrapper_keeps_the_text(page):
    for whole in (page, f"<html><body><nav>menu</nav>{page}<footer>end</footer></body></html>"):
        assert html_main.text_of(whole, set(), set(), set()) == KEPT


@pytest.mark.parametrize("page", [
    f'<article>{BODY}</article><div class="sidebar"><article>teaser</article></div>',
    f'<main>{BODY}</main><form><article>sign up</article></form>',
    f'<div class="post">{BODY}</div><div class="comments"><p>a long comment that says more than the article does</p></div>',
    f'<div class="post">{BODY}</div><aside><article>beside</article></aside>',
    f'<div class="post">{BODY}</div><div class="comments"><article class="comment">said</article></div>',
    f'<div class="post">{BODY}</div><div hidden><article>unseen</article></div>',
])
def test_what_isnt_a_wrapper_stays_out(page):
    assert html_main.text_of(page, set(), set(), set()) == KEPT
