import pytest
from quaywise.llm import html_text

P = "This is a paragraph of some length which goes on for a while so that it counts. " * 4
T = P.strip()

PAGES = {
    "wrapper with a sidebar": (f'<body><div id=content class="with-sidebar"><h1>Title</h1><p>{P}</p><p>{P}</p></div>', f"Title\n\n{T}\n\n{T}"),
    "classes of an article": (f'<article class="post comments-open tag-news social"><p>{P}</p></article>', T),
    "heading and section by slug": (f'<article><h2 id="social-impact">Impact</h2><p>{P}</p><section id="related-work"><h2 id=related>Work</h2><p>{P}</p></section></article>', f"Impact\n\n{T}\n\nWork\n\n{T}"),
    "paragraph of notice": (f'<article><p class="notice">{P}</p></article>', T),
    "wrapper named as boilerplate": (f'<body><div class="page sidebar"><article><p>{P}</p></article></div>', T),
    "boilerplate stays out": (f'<article><p>{P}</p><div class="ad">x</div><p class=ad>x</p><div id="social-share">x</div><div class="sidebar-wrapper">x</div></article>', T),
}


@pytest.mark.parametrize("name", PAGES)
def test_names(name):
    page, want = PAGES[name]
    assert html_text.main_text(page) == want


COMMENT = "I read this with interest and do not agree with what the author says about it, as so often. " * 3
TOKENS = (
    "disqus_thread comment-thread comment-body user-comments post-comments reader-comments ad-slot ad-unit google-ads adsbygoogle advert-large div-gpt-ad-1 "
    "commentsSection article__comment-wrapper leave-a-reply sponsored-content"
).split()


@pytest.mark.parametrize("key", ["class", "id"])
@pytest.mark.parametrize("token", TOKENS)
def test_comments_and_adverts_go(token, key):
    article, other = f"<p>{P}</p>" * 4, f"<div {key}='{token}'>" + f"<p>{COMMENT}</p>" * 3 + "</div>"
    want = "\n\n".join([T] * 4)
    for page in (f"<article>{article}</article>{other}", f"<article>{article}{other}</article>", f"<div id=content><h1>Title</h1>{article}</div>{other}", f"<main>{other}<article>{article}</article></main>"):
        got = html_text.main_text(f"<body>{page}")
        assert got.removeprefix("Title\n\n") == want, (page, got)


def test_more_comments_than_article():
    thread = "".join(f"<li><article class='comment-body' id='div-comment-{i}'><p>{COMMENT}</p></article></li>" for i in range(20))
    page = f"<body><article class='post'><h1>Title</h1><p>{P}</p><p>{P}</p></article><div id='comment-area'><h3>20 Comments</h3><ol>{thread}</ol></div>"
    assert html_text.main_text(page) == f"Title\n\n{T}\n\n{T}"


HARMLESS = {
    "comments-open": f"<div class='entry comments-open'><p>{P}</p><p>{P}</p></div>",
    "ad-free": f"<div class='ad-free'><p>{P}</p></div><div class='no-ads'><p>{P}</p></div>",
    "a subject": f"<article><p>{P}</p><section id='ad-hoc-networks'><h2>Ad hoc networks</h2><p>{P}</p></section></article>",
    "all of the page": f"<div id='comment-story'><p>{P}</p><p>{P}</p></div><p>Short.</p>",
}


@pytest.mark.parametrize("name", HARMLESS)
def test_what_only_sounds_like_it_stays(name):
    assert html_text.main_text("<body>" + HARMLESS[name]).count(T) == 2
