"""Pages whose article is in nested containers, or in containers with telling names, keep all of it."""

import pytest

from codecat.llm import html_extract

LONG, SHORT, TITLE = "long words of the body " * 130, "words of the lead " * 20, "a headline of some sixty letters in all, which names the page"


def texts(sp, pages):
    df = sp.createDataFrame([(i, f"http://h{i % 100}.net/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"].split("\n\n") for r in html_extract.main_text(df).orderBy("id").collect()]


def tidy(*parts):
    return [" ".join(p.split()) for p in parts]


def test_nested_containers(sp):
    h, s, b, other = f"<h1>{TITLE}</h1>", f"<p>{SHORT}</p>", f"<p>{LONG}</p>", "<p>another column</p>"
    pages = {
        f"<article>{h}<div class=body>{b}</div></article>": (TITLE, LONG),
        f"<article><div class=lead>{s}</div><div class=content>{b}</div></article>": (SHORT, LONG),
        f"<body><main><section>{h}</section><article>{s}<div><div>{b}</div></div></article></main><div>{other}</div></body>": (TITLE, SHORT, LONG),
        f"<body><div class=post>{h}<div class=lead>{s}</div><div class=content>{b}</div></div><div class=x>{other}</div></body>": (TITLE, SHORT, LONG),
        f"<body>{h}<div class=content>{b}</div><div class=x>{other}</div></body>": (TITLE, LONG),
        f"<body>{h}<article><div>{b}</div></article><div class=x>{other}</div></body>": (TITLE, LONG),
        f"<div class=post>{s}<blockquote><p>{LONG}</blockquote><nav>{other}</nav></div>": (SHORT, LONG),
    }
    assert texts(sp, pages) == [tidy(*w) for w in pages.values()]


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "layout-with-sidebar", "page-header-fixed", "sidebar-layout", "comments-open", "notice sidebar"])
def test_wrappers_with_telling_names(sp, name):
    article = f"<article><h1>{TITLE}</h1><p>{SHORT}</p></article>"
    pages = [f"<body><p>crumb</p><div class='{name}'>{article}<div class=sidebar><p>side</p></div><div id=comments><p>{LONG}</p></div></div></body>",
             f"<body><div class='{name}'><main><p>{SHORT}</p></main></div></body>"]
    assert texts(sp, pages) == [tidy(TITLE, SHORT), tidy(SHORT)]


def test_slug_ids(sp):
    page = (f'<article><p>{SHORT}</p><h2 id="social-history">Social history</h2><h2 id=menu>Menu</h2><section id="related-work"><p>works</p></section>'
            '<div id="notice-period"><p>a month</p></div><div id="sidebar-left"><p>no</p></div><p class="share-buttons">no</p></article>')
    assert texts(sp, [page]) == [[*tidy(SHORT), "Social history", "Menu", "works", "a month"]]


def test_named_boilerplate_stays_out(sp):
    pages = {f"<div class=post><p>{SHORT}</p></div><div id=comments><article><p>me too</p></article></div>": (SHORT,),
             f"<div class=post><p>{SHORT}</p></div><div class=sidebar><p>{LONG}</p></div><div class='cookie-note'><p>{LONG}</p></div>": (SHORT,),
             f"<main><article><p>{SHORT}</p></article><div class=related-posts><article><p>{LONG}</p></article></div></main>": (SHORT,),
             "<div class=ad-box><p>buy</p></div>": ("",)}
    assert texts(sp, pages) == [tidy(*w) for w in pages.values()]
