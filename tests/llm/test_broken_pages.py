"""Text after unclosed, optional or self-closed tags is read as browsers do."""

import pytest

from tallyscope.llm import labelled_pages, pages_html

BODY = "<article><h1>A title</h1><p>First paragraph of the article, with enough words to read.</p></article>"
WANT = "A title\nFirst paragraph of the article, with enough words to read."


@pytest.fixture(scope="module")
def page_model():
    return pages_html.train(labelled_pages.pages())


def shown(page):
    return " ".join("".join(t for _, _, t in pages_html.parse(page, labelled=False)[1]).split())


@pytest.mark.parametrize("page", [
    f"<body><select><option>one<option>two</select>{BODY}</body>",
    f"<body><select><optgroup><option>one<optgroup><option>two</select>{BODY}</body>",
    f"<body><datalist><option>one<option>two</datalist>{BODY}</body>",
    f"<html><head><title>t</title><meta charset=x><body>{BODY}</body></html>",
    f"<html><head><title>t</title><link rel=x>{BODY}</html>",
    f"<body><div><button>press</div>{BODY}</body>",
    f"<body><button>press{BODY}</body>",
    f"<body><div><select><option>one</div>{BODY}</body>",
    f"<body><table><tr><td><select><option>one<td></table>{BODY}</body>",
    f'<body><svg viewBox="0 0 1 1"/>{BODY}</body>',
    f'<body><svg viewBox="0 0 1 1" />{BODY}<svg></svg></body>',
    f"<body><div><svg><path d='M0'></div>{BODY}</body>",
    f"<body><svg><title/><style/><text>in</text></svg>{BODY}</body>",
    f"<body><svg><title>in</svg>{BODY}</body>",
    f"<body><svg><g>{BODY}</body>",
    f"<body><svg><foreignObject><div>in</div></foreignObject><svg></svg><text>in</text></svg>{BODY}</body>",
    f"<body><svg-icon name='x'></svg-icon>{BODY}</body>",
])
def test_text_after_broken_markup_stays(page_model, page):
    assert pages_html.main_text(page, page_model) == WANT


@pytest.mark.parametrize("page", [
    "<p>a <button><div>press</div></button> b</p>",
    "<p>a <select><option>x</option><option>y</select> b</p>",
    "<div>a <object><p>old</object> b</div>",
    "<div>a <svg><text>x</text><svg><text>y</text></svg><text>z</text></svg> b</div>",
    "<div>a <math><mtext><span>x</span></mtext><mi>y</mi></math> b</div>",
    "<head><title>x</title></head>a b",
])
def test_hidden_text_stays_hidden(page):
    assert shown(page) == "a b"
