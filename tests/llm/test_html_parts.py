from quaywise.llm import html_text

P = [(f"This is paragraph {i} of some length which goes on for a while so that it counts. " * 5).strip() for i in range(6)]


def div(some):
    return "<div>" + "".join(f"<p>{p}</p>" for p in some) + "</div>"


def test_article_in_several_children_of_the_body():
    page = f"<body><h1>Title</h1>{div(P[:3])}{div(P[3:])}</body>"
    assert html_text.main_text(page) == "\n\n".join(["Title", *P])


def test_links_between_the_parts_stay_out():
    links = "<div><ul>" + "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(20)) + "</ul></div>"
    page = f"<body>{links}<h1>Title</h1>{div(P[:3])}{links}<h2>More</h2>{div(P[3:])}{links}</body>"
    assert html_text.main_text(page) == "\n\n".join(["Title", *P[:3], "More", *P[3:]])
