"""Labelled pages in many layouts: what the block classifier of html_content is learned from.

Texts are random syllables, so that the classifier learns shapes and places, not words. On about half of the pages the
names of elements are random or missing, and articles and their parts bear names of other things now and then, so that
names are one hint among others.
"""

from __future__ import annotations

import random

SYLLABLES = "an be co da en er fi ga he in ka la mo na on pe ra sa te tion un ver wi ing ou sch ment ado é ä".split()
#: Ways to mark each kind of boilerplate: opening tags.
AWAY = {
    "nav": ["<nav>", '<div class="nav">', '<div id="main-menu">', '<ul class="navbar-list">', '<div role="navigation">', "<div>"],
    "header": ["<header>", '<div id="header">', '<div class="site-header">', '<div class="masthead">'],
    "footer": ["<footer>", '<div id="footer">', '<div class="page-footer">', '<div role="contentinfo">'],
    "sidebar": ["<aside>", '<div class="sidebar">', '<td class="sidebar">', '<div class="widget">', '<div id="sidebar-primary">'],
    "notice": ['<div class="cookie-notice">', '<div id="consent">', '<div class="notice">', '<div class="alert alert-info">', "<dialog>"],
    "ad": ['<div class="ad">', '<div class="ads">', '<div class="sponsored">', '<div id="ad-slot">', '<p class="advertisement">', '<div class="promo-box">'],
    "form": ["<form>", '<form class="newsletter">', '<div class="newsletter-signup">', '<form action="/login">'],
    "related": ['<div class="related">', '<section class="related-posts">', '<div class="share-links">', "<aside>"],
    "comments": ['<section id="comments">', '<div class="comments">', '<ol class="comment-list">', '<div class="discussion">', '<ul class="replies">'],
}
MAIN = ["<article>", "<main>", '<div class="content">', '<div id="post">', '<div class="entry-content">', "<div>", "<div>", "<td>", '<section class="story">', "<form>", '<div class="content-sidebar-wrap">', ""]


#: Names of other things that articles and parts of them may have.
ELSEWHERE = ["social", "menu", "legal", "related", "search", "promo", "notice-board", "alert-system", "widget", "tag-social category-news", "banner-story"]


def _word(r: random.Random) -> str:
    return "".join(r.choices(SYLLABLES, k=r.choice((1, 2, 2, 3, 4))))


def _sentence(r: random.Random) -> str:
    words = [_word(r) for _ in range(r.choice((2, 4, 7, 10, 14, 20)))]
    return (" ".join(words)).capitalize() + r.choice("....!?")


def _prose(r: random.Random, most: int = 8) -> str:
    return " ".join(_sentence(r) for _ in range(r.randint(1, most)))


def _end(tag: str) -> str:
    return f"</{tag[1:].split()[0].strip('>')}>" if tag else ""


class _Page:
    def __init__(self, r: random.Random):
        self.r, self.says = r, {}
        self.style = r.choice(("named", "named", "named", "random", "nameless"))
        self.main = r.choice(MAIN)
        if self.main == "<article>" and r.random() < 0.5:
            self.main = f'<article class="post {r.choice(ELSEWHERE)}">'
        #: Whether the page's own elements tell where the content ends.
        self.framed = self.main.startswith(("<article", "<main"))

    def _marked(self, tag: str) -> str:
        """tag with the names that this page's style has."""
        if self.style == "named" or " " not in tag or tag.startswith("<form"):
            return tag
        bare = tag[1:].split()[0]
        return f"<{bare}>" if self.style == "nameless" else f'<{bare} class="{_word(self.r)}">'

    def text(self, text: str, content: bool, wrap: str) -> str:
        """wrap with the text in it, which is remembered with its label."""
        text = " ".join(text.split())
        self.says[text] = content
        return wrap.replace("@", text)

    def links(self, n: int, wrap: str = "<li>@</li>") -> str:
        """Short links, one block each."""
        return "".join(self.text(" ".join(_word(self.r) for _ in range(self.r.choice((1, 1, 2, 4)))), False, wrap.replace("@", '<a href="/x">@</a>')) for _ in range(n))

    def away(self, kind: str) -> str:
        r = self.r
        tag = self._marked(r.choice(AWAY[kind]))
        if self.style != "named" and not self.framed and kind in ("ad", "notice", "comments", "header"):
            return ""  # nothing would tell it from content
        inside = ("@",) if tag.startswith("<p") else ("@", "<p>@</p>", "<div>@</div>")
        prose = lambda most=2: self.text(_prose(r, most), False, r.choice(inside))
        if kind == "nav":
            inner = f"<ul>{self.links(r.randint(2, 8))}</ul>" if r.random() < 0.7 else self.text(" | ".join(_word(r) for _ in range(4)), False, "<a href=/>@</a>")
        elif kind == "header":
            inner = self.text(_word(r).title() + " " + _word(r), False, r.choice(("<h1>@</h1>", "<p>@</p>", "@"))) + self.links(r.randint(0, 4), "<p>@</p>")
        elif kind == "footer":
            inner = self.text(f"© {_word(r)}.example · {_prose(r, 2)}", False, r.choice(("@", "<p>@</p>"))) + self.links(r.randint(0, 4))
        elif kind in ("sidebar", "related"):
            inner = self.text(_word(r).title(), False, "<h3>@</h3>") + (prose() if r.random() < 0.6 else "") + f"<ul>{self.links(r.randint(1, 5))}</ul>"
        elif kind == "form":
            inner = self.text(_sentence(r), False, r.choice(("<label>@</label><input>", "<p>@</p><input>")))
        elif kind == "comments":
            item = r.choice(("<p>@</p>", '<li class="comment"><p>@</p></li>', "<article><p>@</p></article>", '<div class="reply"><p>@</p></div>'))
            inner = self.text(_word(r).title(), False, "<h3>@</h3>") + "".join(self.text(_prose(r, 3), False, item) for _ in range(r.randint(1, 5)))
        else:
            inner = prose(3)
        return tag + inner + _end(tag)

    def content(self) -> str:
        r, out = self.r, []
        if r.random() < 0.8:
            title = self.text(_sentence(r)[: r.randint(12, 60)].strip(), True, "<h1>@</h1>")
            out.append(f"<header>{title}</header>" if r.random() < 0.15 else title)
        for _ in range(r.choice((1, 2, 4, 8, 14))):
            k = r.random()
            if k < 0.05:
                out.append(self.text(_prose(r, 2), True, '<p><a href="/y">@</a></p>'))
            elif k < 0.1:
                out.append(f'<div class="{r.choice(ELSEWHERE)}">' + self.text(_prose(r), True, "<p>@</p>") + "</div>")
            elif k < 0.7:
                out.append(self.text(_prose(r), True, "<p>@</p>"))
            elif k < 0.78:
                out.append(self.text(_prose(r, 2), True, r.choice(("<p><b>@</b>", "<div>@</div>", "<blockquote>@</blockquote>", "<p><i>@</i><br>", "@<hr>"))))
            elif k < 0.86:
                out.append(self.text(_sentence(r)[:40].strip(), True, r.choice(("<h2>@</h2>", "<h3>@</h3>", "<figcaption>@</figcaption>"))))
            elif k < 0.94:
                out.append("<ul>" + "".join(self.text(_prose(r, 1), True, "<li>@</li>") for _ in range(r.randint(2, 5))) + "</ul>")
            else:
                out.append("<table>" + "".join("<tr>" + self.text(_sentence(r), True, "<td>@</td>") + self.text(_word(r) + " " + str(r.randint(1, 999)), True, "<td>@</td>") + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
        for kind in ("ad", "related", "form", "notice"):
            if r.random() < 0.2 and (self.style == "named" or kind in ("related", "form")):
                out.insert(r.randint(1, len(out)), self.away(kind))
        return "".join(out)


def page(seed: int) -> tuple[str, dict[str, bool]]:
    """(html, text of a block -> whether it is content) of one page."""
    r = random.Random(seed)
    p = _Page(r)
    if r.random() < 0.08:
        return "<body>" + p.text(_prose(r, 2) if r.random() < 0.5 else _word(r) + " " + _word(r), True, r.choice(("@", "<p>@</p>", "<div>@</div>"))) + "</body>", p.says
    tag = p.main if p.style == "named" or p.framed else p._marked(p.main)
    content = tag + p.content() + (p.away("comments") if r.random() < 0.3 and p.style == "named" else "") + _end(tag)
    before = [p.away(k) for k in ("header", "nav", "notice", "ad") if r.random() < 0.5]
    after = [p.away(k) for k in ("comments", "sidebar", "related", "form", "ad", "footer") if r.random() < 0.4]
    if r.random() < 0.2 and after:
        before.append(after.pop(0))
    body = "".join(before) + content + "".join(after)
    wrap = r.choice(("@", "@", "<div>@</div>", '<div class="page-wrapper">@</div>', "<table><tr>@</tr></table>" if tag == "<td>" else "<div><div>@</div></div>"))
    return f"<!DOCTYPE html><html><head><title>{_word(r)}</title></head><body>{wrap.replace('@', body)}</body></html>", p.says


def pages(first: int = 0, number: int = 600) -> list[tuple[str, dict[str, bool]]]:
    """``number`` labelled pages, the same at every call."""
    return [page(k) for k in range(first, first + number)]
