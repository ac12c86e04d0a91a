"""Density decides, attributes are read whole, and broken pages take no more time than others."""

import time

import pytest
from quaywise.llm import html_text

P = [(f"This is paragraph {i} of some length which goes on for a while so that it counts. " * 5).strip() for i in range(8)]
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Link number {i}</a></li>" for i in range(25)) + "</ul>"


def paragraphs(some):
    return "".join(f"<p>{p}</p>" for p in some)


PAGES = {
    "density alone, no name or tag to go by": (f"<body><div>{LINKS}</div><div><div>{paragraphs(P[:4])}</div></div><div>{LINKS}</div><div><a href=1>Imprint</a></div></body>", P[:4]),
    "links around the text in one wrapper": (f"<body><div><div>{LINKS}</div><div>{paragraphs(P[:3])}</div><div>{LINKS}</div></div></body>", P[:3]),
    "an article element that is a teaser list": (f"<body><article>{LINKS}</article><div>{paragraphs(P[:4])}</div></body>", P[:4]),
    "sidebar class of the wrapper": (f'<body><div class="content has-sidebar"><p>{P[0]}</p><p>{P[1]}</p></div></body>', P[:2]),
    "article with open comments": (f'<body><article class="post comments-open"><p>{P[0]}</p></article><div class="comments"><p>{P[1]}</p></div></body>', P[:1]),
    "title that says hidden": (f'<body><article><p title="hidden gem">{P[0]}</p></article></body>', P[:1]),
    "links whose target looks like an attribute": (f'<body><article><p>See <a href="/hidden/path">this</a> and <a href="/x?id=ad">that</a>. {P[0]}</p></article></body>', [f"See this and that. {P[0]}"]),
    "data attribute that ends in id": (f'<body><article><p data-video-id="menu">{P[0]}</p></article></body>', P[:1]),
    "label in a sentence": (f"<body><article><p>The <label>red</label> one. {P[0]}</p></article></body>", [f"The red one. {P[0]}"]),
    "form around the whole page": (f"<body><form action=/><nav>{LINKS}</nav><h1>Title</h1>{paragraphs(P[:3])}<input name=q><select><option>x</select></form></body>", ["Title", *P[:3]]),
    "comments that are longer than the article": (f"<body><article><h1>T</h1><p>{P[0]}</p></article><section id=comments>{paragraphs(P[1:])}</section></body>", ["T", P[0]]),
    "hidden wrapper": (f"<body><div hidden><h1>No</h1>{paragraphs(P[:4])}</div><p>{P[5]}</p></body>", [P[5]]),
    "header and footer of the page": (f"<body><header><h1>Site</h1></header><main><header><h2>Head</h2></header><p>{P[0]}</p><footer>by me</footer></main><footer>x</footer></body>", ["Head", P[0]]),
    "menu that is never ended": (f"<body><nav>Home<div><h1>Title</h1>{paragraphs(P[:2])}</div></body>", ["Title", *P[:2]]),
    "quote that is never ended": (f"<body><article><p class='>x{P[0]}</p><p>{P[1]}</p></article></body>", None),
    "first attribute of a name counts": (f'<body><article><p class="lead" class="ad">{P[0]}</p></article></body>', P[:1]),
    "references in attributes": (f'<body><article><div class="&#97;d">x</div><p>{P[0]}</p></article></body>', P[:1]),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    got = html_text.main_text(page)
    assert isinstance(got, str) if want is None else got == "\n\n".join(want)


def test_the_core_is_the_node_of_the_greatest_sum():
    page = html_text.Page(PAGES["density alone, no name or tag to go by"][0])
    dense, sums, chars, linked, tags = page.densities()
    core = max(range(len(sums)), key=sums.__getitem__)
    assert [page.tags[i] for i in range(len(sums)) if page.parents[i] == core] == ["p"] * 4
    for i in range(len(sums)):
        assert sums[i] == pytest.approx(sum(dense[j] for j in range(len(sums)) if page.parents[j] == i))
    lists = [i for i, t in enumerate(page.tags) if t == "ul"]
    assert max(dense[i] for i in lists) < min(dense[i] for i in range(len(sums)) if page.parents[i] == core)


@pytest.mark.parametrize("part", ["<nav>x", "<div>x", "<div class=ad>x", "<a b='x>", '<a "x>', "<svg>x", "<!-- x", "<ul><li>x", "</p></div>", "<b><p>x", "<table><tr><td>x", "<script>x"])
def test_time_grows_with_the_length(part):
    took = []
    for n in (4000, 20_000):
        page = f"<body><article><h1>T</h1><p>{P[0]}</p>" + part * n
        began = time.perf_counter()
        assert isinstance(html_text.main_text(page), str)
        took.append(time.perf_counter() - began)
    assert took[1] < 2 and took[1] < 15 * max(took[0], 0.02)
