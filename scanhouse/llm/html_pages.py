"""Labelled pages to train the extraction model on: invented layouts with the article marked.

``labelled_page(rng)`` makes one page. Regions carry ``data-main``: "1" for the article, "0" for what
is no article though it stands in it. Layouts, element and class names and lengths vary, and some pages
have meaningless class names, so that the model can't lean on one sign alone.
"""

from __future__ import annotations

import random

# Class and id names that pages give to their regions.
NAMES = {
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs main-nav site-nav nav-links tabs toc",
    "header": "header masthead site-header page-header banner-top topbar branding logo hero-bar",
    "footer": "footer site-footer page-footer bottom colophon foot legal copyright footer-widgets",
    "sidebar": "sidebar side aside rail right-rail widget widget-area related related-posts popular trending recommended more-stories tags tag-cloud",
    "notice": "notice cookie cookie-notice consent gdpr alert message popup modal overlay paywall subscribe-wall site-notice disclaimer cookie-banner",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsbox ad-slot commercial partner-content",
    "form": "form newsletter subscribe signup sign-up contact login search search-form search-box feedback",
    "comments": "comments comment-list responses discussion replies reader-comments disqus comment-section feedback-list",
    "share": "share social sharing toolbar share-buttons social-links follow tools",
    "wrapper": "wrapper container layout row columns site page wrap inner grid body-wrap main-wrap content-area",
    "article": "article post entry story content main-content article-body post-content entry-content story-body text body-text post-body page-content main",
}
CONSONANTS, VOWELS = "bcdfghlmnprstvw", "aeiou"


def _vocabulary(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(CONSONANTS) + rng.choice(VOWELS) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "n", "s"]) for _ in range(n)]


WORDS = _vocabulary(random.Random(1), 2000)


def _words(rng: random.Random, n: int) -> list[str]:
    return rng.choices(WORDS, k=n)


def _prose(rng: random.Random, n: int) -> str:
    words = _words(rng, n)
    for i in range(0, n, max(4, rng.randint(5, 14))):
        words[i] = words[i].capitalize()
        if i:
            words[i - 1] += rng.choice(".....?!,:")
    odd = rng.random()
    if odd < 0.1:  # junk between the words
        mark = rng.choice([" |", "&amp;&amp;", "***", "!!", "###"])
        words = [w + mark for w in words]
    elif odd < 0.14:
        words = [w.upper() for w in words]
    return " ".join(words) + rng.choice([".", ".", ".", "!", ""])


def _inline(rng: random.Random, text: str) -> str:
    """Some words of a text in bold, in italics or linked."""
    words = text.split(" ")
    for tag in rng.sample(["b", "i", "em", "strong", "a href='/x'", "span", "code"], rng.randint(0, 3)):
        k = rng.randrange(len(words))
        words[k] = f"<{tag}>{words[k]}</{tag.split()[0]}>"
    return " ".join(words)


def _few(rng: random.Random, most: int = 8) -> str:
    return _prose(rng, rng.randint(1, most))


class Layout:
    """Choices that hold for one page: whether names mean something, and how."""

    def __init__(self, rng: random.Random, names: dict[str, list[str]]):
        self.rng, self.names = rng, names
        self.meaningless = rng.random() < 0.2
        self.plain = rng.random() < 0.15  # no class names at all

    def region(self, kind: str, inner: str, mark: str | None, tags: list[str]) -> str:
        rng = self.rng
        tag = rng.choice(tags)
        attrs = ""
        if not self.plain and (tag in ("div", "section", "ul", "td", "span", "p") or rng.random() < 0.5):
            name = f"x{rng.randrange(16**6):06x}" if self.meaningless else rng.choice(self.names[kind])
            if not self.meaningless and rng.random() < 0.3:
                name += rng.choice([" ", "-", "_", " is-"]) + rng.choice(["wide", "box", "wrap", "inner", "block", "left", "item", "1", "container"])
            attrs = f' {rng.choice(["class", "class", "id"])}="{name}"'
        if mark is not None:
            attrs += f' data-main="{mark}"'
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def links(self, n: int, wrap: str = "li") -> str:
        items = [f'<a href="/{i}">{" ".join(_words(self.rng, self.rng.randint(1, 4)))}</a>' for i in range(n)]
        if wrap == "li":
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return wrap.join(items)

    def menu(self) -> str:
        n = self.rng.randint(2, 12)
        return self.region("menu", self.links(n, self.rng.choice(["li", "li", " | ", " "])), "0", ["nav", "nav", "div", "ul"])

    def header(self) -> str:
        rng = self.rng
        parts = [f"<a href='/'>{_few(rng, 3)}</a>", rng.choice(["", f"<p>{_few(rng)}</p>", f"<h1>{_few(rng, 3)}</h1>"])]
        return self.region("header", "".join(parts) + (self.menu() if rng.random() < 0.3 else ""), "0", ["header", "header", "div"])

    def footer(self) -> str:
        rng = self.rng
        body = rng.choice(["&copy; ", "Copyright ", ""]) + rng.choice([_few(rng, 20), f"<p>{_few(rng, 25)}</p>", f"example.com &middot; {_few(rng, 12)}"])
        return self.region("footer", body + (self.links(rng.randint(2, 6), " ") if rng.random() < 0.5 else ""), "0", ["footer", "footer", "div"])

    def sidebar(self) -> str:
        rng = self.rng
        parts = []
        for _ in range(rng.randint(1, 3)):
            teaser = rng.choice([self.links(rng.randint(2, 8)), f"<p>{_few(rng, 30)} <a href='/m'>more</a></p>", f"<p>{_few(rng, 20)}</p>"])
            parts.append(f"<h3>{_few(rng, 4)}</h3>" + teaser)
        return self.region("sidebar", "".join(parts), "0", ["aside", "aside", "div", "section"])

    def notice(self) -> str:
        rng = self.rng
        body = rng.choice([f"<p>{_few(rng, 40)}</p>", _few(rng, 25)])
        return self.region("notice", body + rng.choice(["", f"<button>{_few(rng, 2)}</button>", f"<a href='#'>{_few(rng, 2)}</a>"]), "0", ["div", "div", "section", "p"])

    def advert(self) -> str:
        rng = self.rng
        body = rng.choice([_few(rng, 15), f"<p>{_few(rng, 25)}</p>", f"<a href='/b'><b>{_few(rng, 4)}</b> {_few(rng)}</a>"])
        return self.region("advert", body, "0", ["div", "div", "aside", "ins", "section"])

    def form(self) -> str:
        rng = self.rng
        fields = f"<label>{_few(rng, 3)}</label><input name='q'>" + rng.choice(["", f"<button>{_few(rng, 2)}</button>", "<textarea>x</textarea>"])
        inner = f"<form>{rng.choice(['', f'<p>{_few(rng, 15)}</p>', f'<h3>{_few(rng, 4)}</h3>'])}{fields}</form>"
        return self.region("form", inner, "0", ["div", "section"]) if rng.random() < 0.6 else inner.replace("<form>", '<form data-main="0">')

    def share(self) -> str:
        return self.region("share", self.links(self.rng.randint(2, 5), self.rng.choice([" ", "li"])), "0", ["div", "ul", "p"])

    def comments(self) -> str:
        rng = self.rng
        items = []
        for _ in range(rng.randint(1, 6)):
            text = "".join(f"<p>{_inline(rng, _prose(rng, rng.randint(2, 60)))}</p>" for _ in range(rng.randint(1, 2)))
            who = rng.choice(["", f"<b>{_few(rng, 2)}</b>", f"<a href='/u'>{_few(rng, 2)}</a>", f"<cite>{_few(rng, 2)}</cite>"])
            tag = rng.choice(["div", "div", "div", "li", "li", "article"])
            items.append(f"<{tag}" + ("" if self.plain or self.meaningless else rng.choice(["", ' class="comment"', ' class="reply"'])) + f">{who}{text}</{tag}>")
        return self.region("comments", f"<h3>{_few(rng, 3)}</h3>" + "".join(items) + (self.form() if rng.random() < 0.4 else ""), "0", ["section", "div", "ol"])

    def article(self) -> str:
        rng = self.rng
        blocks = []
        if rng.random() < 0.8:
            title = f"<h1>{_few(rng, 9)}</h1>"
            blocks.append(rng.choice([title, title, title, f"<header>{title}</header>"]))
        style = rng.choice(["p", "p", "p", "unclosed", "div", "br"])
        for _ in range(rng.choice([1, 2, 3, rng.randint(4, 14)])):
            n = rng.choice([rng.randint(1, 4), rng.randint(3, 30), rng.randint(20, 120)])
            text = _inline(rng, _prose(rng, n))
            if rng.random() < 0.1:  # a long paragraph
                text = " ".join([text] * rng.randint(2, 80))
            kind = rng.random()
            if kind < 0.78:
                blocks.append({"p": f"<p>{text}</p>", "unclosed": f"<p>{rng.choice(['', '<b>'])}{text}{rng.choice(['', '<br>'])}", "div": f"<div>{text}</div>", "br": f"{text}<br><br>"}[style])
            elif kind < 0.86:
                blocks.append(f"<h2>{_few(rng, 6)}</h2>")
            elif kind < 0.92:
                tag = rng.choice(["ul", "ol"])
                blocks.append(f"<{tag}>" + "".join(f"<li>{_inline(rng, _few(rng, 12))}</li>" for _ in range(rng.randint(1, 6))) + f"</{tag}>")
            elif kind < 0.95:
                blocks.append(f"<blockquote>{rng.choice([text, f'<p>{text}</p>'])}</blockquote>")
            elif kind < 0.97:
                rows = "".join("<tr>" + "".join(f"<td>{_few(rng, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4)))
                blocks.append(f"<table>{rows}</table>")
            else:
                blocks.append(f"<pre>{_few(rng, 12)}</pre>")
        for make, share in ((self.advert, 0.25), (self.share, 0.15), (self.sidebar, 0.15), (self.form, 0.1), (self.notice, 0.1)):
            if rng.random() < share:
                blocks.insert(rng.randrange(len(blocks) + 1), make())
        if rng.random() < 0.15:
            blocks.append(self.comments())
        inner = "".join(blocks)
        if rng.random() < 0.2:
            inner = self.region("article", inner, None, ["div", "section"])
        return self.region("article", inner, "1", ["article", "article", "article", "article", "main", "main", "div", "div", "div", "div", "section", "td"])


def labelled_page(rng: random.Random, names: dict[str, list[str]] | None = None) -> str:
    """One page; ``names`` replaces the class names (as for a test with unseen ones)."""
    page = Layout(rng, names or {k: v.split() for k, v in NAMES.items()})
    body = [page.header()] if rng.random() < 0.5 else []
    for make, share in ((page.menu, 0.8), (page.notice, 0.35), (page.advert, 0.5), (page.form, 0.2)):
        if rng.random() < share:
            body.append(make())
    middle = [page.article()] if rng.random() < 0.97 else []
    if middle and middle[0].startswith("<td"):
        middle[0] = f"<table><tr>{rng.choice(['', '<td data-main=0>' + page.links(4) + '</td>'])}{middle[0]}</tr></table>"
    if rng.random() < 0.5:
        middle.insert(rng.randrange(len(middle) + 1), page.sidebar())
    if rng.random() < 0.35:
        middle.append(page.comments())
    body.append(page.region("wrapper", "".join(middle), None, ["div"] * 7 + ["section", "main"]) if rng.random() < 0.35 else "".join(middle))
    for make, share in ((page.sidebar, 0.15), (page.advert, 0.2), (page.menu, 0.1), (page.footer, 0.85), (page.notice, 0.25)):
        if rng.random() < share:
            body.append(make())
    inner = "".join(body)
    if rng.random() < 0.4:
        inner = f"<div id='page'>{inner}</div>"
    if rng.random() < 0.08:  # a fragment
        return inner
    head = f"<head><title>{_few(rng)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
    return f"<!DOCTYPE html><html>{head}<body>{inner}{rng.choice(['</body></html>', ''])}"
