"""Labelled pages on which the page model is trained: usual layouts, filled with invented words.

`data-label` says whether an element is content; descendants inherit it.
"""

from __future__ import annotations

import random

#: Class and id words that name regions of pages, and elements often used for them.
OUTSIDE = {
    "menu": (["nav", "div", "ul"], "nav navbar navigation menu topmenu breadcrumb breadcrumbs tabs pagination pager toc skip links"),
    "header": (["header", "div"], "header masthead banner logo branding topbar sitename login search"),
    "footer": (["footer", "div"], "footer bottom copyright legal imprint colophon sitemap social"),
    "sidebar": (["aside", "div", "section"], "sidebar side aside widget rail related recommended popular trending tags archive author bio"),
    "notice": (["div", "section", "p"], "cookie cookies consent notice alert banner gdpr paywall modal popup overlay newsletter subscribe signup"),
    "advert": (["div", "aside", "section", "ins"], "ad ads advert advertisement sponsor sponsored promo promotion adsense banner commercial"),
    "comments": (["section", "div", "ol", "article"], "comment comments reply replies discussion disqus respond thread feedback review"),
    "share": (["div", "ul"], "share sharing social like follow twitter facebook print email"),
    "form": (["form"], "form search login contact subscribe register"),
}
INSIDE = "article post entry content story main body text page hentry prose"


def _words(rng: random.Random, low: int, high: int) -> str:
    letters = "aeioulnrstdm"
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(rng.randint(low, high)))


def _heading(rng: random.Random, low: int, high: int) -> str:
    level = rng.randint(2, 4)
    return f"<h{level}>{_words(rng, low, high)}</h{level}>"


def _links(rng: random.Random) -> str:
    return "<ul>" + "".join(f'<li><a href="/{k}">{_words(rng, 1, 3)}</a></li>' for k in range(rng.randint(3, 7))) + "</ul>"


def _outside(rng: random.Random, region: str) -> str:
    tags, names = OUTSIDE[region]
    tag, name = rng.choice(tags), rng.choice(names.split())
    attribute = rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {rng.choice(names.split())}"', ""]) if tag in ("nav", "header", "footer", "aside", "form") else f' {rng.choice(["class", "id"])}="{name}"'
    if region == "form":
        body = f"<label>{_words(rng, 1, 3)}</label><input name='q'><p>{_words(rng, 2, 8)}</p>"
    elif region == "comments":
        one = rng.choice(["div", "li", "article", "section"])
        body = _heading(rng, 1, 2) + "".join(f'<{one} class="{rng.choice(["comment", "reply", "comment-body"])}"><p>{_words(rng, 4, 60)}</p></{one}>' for _ in range(rng.randint(1, 4)))
    elif region in ("menu", "share"):
        body = _links(rng) if tag != "ul" else _links(rng)[4:-5]
    elif region == "sidebar":
        body = _heading(rng, 1, 3) + rng.choice([_links(rng), f"<p>{_words(rng, 5, 30)}</p>"])
    else:
        body = rng.choice([_words(rng, 3, 14), f"<p>{_words(rng, 4, 25)}</p>", f"&copy; {_words(rng, 2, 8)} <a href='/x'>{_words(rng, 1, 2)}</a>", _words(rng, 8, 40)])
    return f'<{tag}{attribute} data-label="0">{body}</{tag}>'


def _inline(rng: random.Random) -> str:
    """Something named within a line: an advert or a label, or a part of the text."""
    if rng.random() < 0.4:
        return f'<{(tag := rng.choice(["span", "ins", "a", "a", "small"]))} {rng.choice(["class", "id"])}="{rng.choice(OUTSIDE[rng.choice(["advert", "advert", "share", "notice"])][1].split())}" data-label="0">{_words(rng, 1, 6)}</{tag}>'
    return f'<{(tag := rng.choice(["span", "em", "strong", "a", "code", "mark"]))} class="{rng.choice(["highlight", "term", "name", "link", "lead", "first", "quote", "external"])}">{_words(rng, 1, 5)}</{tag}>'


def _paragraph(rng: random.Random) -> str:
    kind = rng.random()
    if kind < 0.16:
        most = rng.choice([2, 5, 30])
        return f"<p>{_words(rng, 1, most)} {_inline(rng)} {_words(rng, 0, most)}</p>"
    if kind < 0.26:
        return f'<p>{_words(rng, 0, 3)} <a href="/a">{_words(rng, 1, 20)}</a></p>'
    if kind < 0.58:
        text = _words(rng, 1, 90)
        return f"<p>{text}</p>" if rng.random() < 0.7 else f'<p>{text} <a href="/a">{_words(rng, 1, 3)}</a> {_words(rng, 3, 20)}</p>'
    if kind < 0.64:
        return f"<div>{_words(rng, 2, 60)}</div>" if rng.random() < 0.5 else f"<div><p>{_words(rng, 2, 60)}</p></div>"
    if kind < 0.8:
        return _heading(rng, 1, 7)
    if kind < 0.86:
        return "<ul>" + "".join(f"<li>{_words(rng, 2, 18)}</li>" for _ in range(3)) + "</ul>"
    if kind < 0.9:
        return f"<blockquote><p>{_words(rng, 5, 40)}</p></blockquote>"
    if kind < 0.93:
        return f"<pre>{_words(rng, 3, 30)}</pre>"
    if kind < 0.96:
        return "<table><tbody>" + "".join(f"<tr><td>{_words(rng, 1, 4)}</td><td>{_words(rng, 1, 4)}</td></tr>" for _ in range(3)) + "</tbody></table>"
    return f"<figure><figcaption>{_words(rng, 3, 12)}</figcaption></figure>"


def pages(count: int = 800, seed: int = 3) -> list[str]:
    """Labelled pages, the same for the same arguments."""
    rng, out = random.Random(seed), []
    for _ in range(count // 4):  # pages that are nothing but an article, often a short one
        most = rng.choice([1, 3, 8, 40])
        text = lambda: _words(rng, 1, most)  # noqa: E731, B023
        inner = rng.choice(
            [f"<p>{text()}</p>", f"<div>{text()}</div>", f"<div><p>{text()}</p></div>", f"<ul><li>{text()}</li><li>{text()}</li></ul>", f"<ul><li>{text()}</li></ul>", f"<ol><li>{text()}</li></ol>", text(), f"<h1>{text()}</h1>",
             f"<section><p>{text()}</p></section>", f"<table><tr><td>{text()}</td></tr></table>", f"<blockquote>{text()}</blockquote>", f"<p>{_words(rng, 0, 2)} <a>{text()}</a></p><p>{text()}</p>", f"<p><a>{text()}</a></p><p>{text()}</p>", f"<pre>{text()}</pre>", f"<dl><dt>{text()}</dt><dd>{text()}</dd></dl>", "".join(_paragraph(rng) for _ in range(rng.randint(1, 4)))]
        )
        tag = rng.choice(["article", "main", "div", "section", ""])
        out.append(f'<html><body data-label="1">{f"<{tag}>{inner}</{tag}>" if tag else inner}</body></html>')
    for _ in range(count):
        before = [r for r in ("header", "menu", "notice", "advert", "form") if rng.random() < 0.5]
        after = [r for r in ("comments", "sidebar", "share", "advert", "form", "notice", "footer") if rng.random() < 0.45]
        body = [f"<h1>{_words(rng, 2, 12)}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 12)):
            body.append(_paragraph(rng))
            if rng.random() < 0.06:
                body.append(_outside(rng, rng.choice(["advert", "share", "sidebar", "notice", "comments"])))
        inner = "".join(body)
        name = rng.choice(INSIDE.split())
        tag = rng.choice(["article", "article", "main", "div", "section"])
        inner = f'<{tag} class="{name}" data-label="1">{inner}</{tag}>' if tag in ("div", "section") or rng.random() < 0.4 else f'<{tag} data-label="1">{inner}</{tag}>'
        if rng.random() < 0.4:
            inner = f'<{rng.choice(["main", "div"])} {rng.choice(["class", "id"])}="{rng.choice(["container", "wrapper", "content", "main", "page", "row"])}" data-label="1">{inner}{"".join(_outside(rng, r) for r in after[:2])}</div>'
            after = after[2:]
        outer = "".join(_outside(rng, r) for r in before) + inner + "".join(_outside(rng, r) for r in after)
        out.append(f'<html><head><title>{_words(rng, 2, 8)}</title></head><body data-label="1">{outer}</body></html>')
    return out
