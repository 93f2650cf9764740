"""Pages with a label for each leaf block, to train and to test the main-text field.

The pages are put together at random, from a fixed seed, from the ways in which sites
mark up articles and what surrounds them.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

# Lines that sound like what surrounds an article; they occur inside articles too.
SOUNDS_LIKE = (
    "All rights reserved.",
    "Copyright is a right of its own.",
    "Cookies are baked for an hour.",
    "Share it with your home.",
    "The comments were kind, the reply was not.",
    "Search, and log in, they said.",
    "A sponsored walk, an advertisement for shoes.",
    "Subscribe to nothing.",
)
SYLLABLES = "an be con der en for ge ha in ka lo men ni on per qui re sta ter un ver wo".split()


@dataclass
class Page:
    html: str = ""
    labels: list[bool] = field(default_factory=list)


class Writer:
    """Writes one page; every leaf block is written through ``block``."""

    def __init__(self, seed: int):
        self.pick = random.Random(seed)
        self.parts: list[str] = []
        self.labels: list[bool] = []

    def word(self) -> str:
        return "".join(self.pick.choice(SYLLABLES) for _ in range(self.pick.randint(1, 3)))

    def words(self, least: int, most: int, stop: str = "") -> str:
        text = " ".join(self.word() for _ in range(self.pick.randint(least, most)))
        return text[:1].upper() + text[1:] + stop

    def sentences(self, least: int = 1, most: int = 6) -> str:
        return " ".join(self.words(1, 16, ".") for _ in range(self.pick.randint(least, most)))

    def raw(self, html: str) -> None:
        self.parts.append(html)

    def block(self, tag: str, text: str, label: bool, attributes: str = "") -> None:
        close = "" if tag in ("p", "li") and self.pick.random() < 0.15 else f"</{tag}>"
        self.parts.append(f"<{tag}{attributes}>{text}{close}")
        self.labels.append(label)

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def named(self, *names: str) -> str:
        return f' {self.pick.choice(("class", "id"))}="{self.pick.choice(names)}"'

    def chance(self, p: float) -> bool:
        return self.pick.random() < p

    def links(self, n: int) -> None:
        self.raw("<ul>")
        for _ in range(n):
            self.block("li", self.link(self.words(1, 3)), False)
        self.raw("</ul>")

    # What surrounds an article.

    def menu(self) -> None:
        tag, attributes = self.pick.choice(
            [("nav", ""), ("div", self.named("menu", "nav", "navbar", "main-menu")), ("div", ' role="navigation"'), ("nav", self.named("nav"))]
        )
        self.raw(f"<{tag}{attributes}>")
        if self.chance(0.8):
            self.links(self.pick.randint(3, 8))
        else:
            self.block("div", " | ".join(self.link(self.words(1, 2)) for _ in range(5)), False)
        self.raw(f"</{tag}>")

    def top(self) -> None:
        tag, attributes = self.pick.choice([("header", ""), ("div", self.named("header", "masthead", "topbar", "banner")), ("header", ' role="banner"')])
        self.raw(f"<{tag}{attributes}>")
        self.block(self.pick.choice(("h1", "h2", "div", "p")), self.link(self.words(1, 4)), False)
        if self.chance(0.6):
            self.block(self.pick.choice(("p", "div")), self.words(3, 8, self.pick.choice(("", "."))), False)
        if self.chance(0.4):
            self.menu()
        self.raw(f"</{tag}>")

    def bottom(self) -> None:
        tag, attributes = self.pick.choice([("footer", ""), ("div", self.named("footer", "bottom", "site-footer")), ("footer", ' role="contentinfo"')])
        self.raw(f"<{tag}{attributes}>")
        if self.chance(0.4):
            self.links(self.pick.randint(2, 5))
        if self.chance(0.7):
            self.block(self.pick.choice(("p", "div")), self.pick.choice(("All rights reserved. ", "", "")) + f"&copy; {self.word()}.example &middot; {self.sentences(1, 2)}", False)
        else:
            self.block("p", self.sentences(1, 2), False)
        self.raw(f"</{tag}>")

    def side(self) -> None:
        tag, attributes = self.pick.choice([("aside", ""), ("div", self.named("sidebar", "related", "widget", "trending")), ("aside", self.named("sidebar"))])
        self.raw(f"<{tag}{attributes}>")
        self.block(self.pick.choice(("h2", "h3", "h4", "p")), self.words(1, 4), False)
        if self.chance(0.6):
            self.links(self.pick.randint(2, 6))
        for _ in range(self.pick.randint(0, 2)):
            self.block("p", self.sentences(1, 3), False)
        self.raw(f"</{tag}>")

    def advert(self) -> None:
        tag = self.pick.choice(("div", "aside", "p", "section"))
        self.block(tag, self.sentences(1, 2) if self.chance(0.7) else self.link(self.words(2, 6)), False, self.named("ad", "ads", "advert", "sponsored", "promo", "ad-box"))

    def notice(self) -> None:
        tag = self.pick.choice(("div", "section", "dialog"))
        self.raw(f"<{tag}{self.named('cookie-notice', 'consent', 'cookie-banner', 'notice', 'alert', 'gdpr', 'popup')}>")
        self.block("p", self.pick.choice(("We use cookies. ", "", "")) + self.sentences(1, 3), False)
        if self.chance(0.6):
            self.block("div", f"<button>{self.words(1, 2)}</button>", False)
        self.raw(f"</{tag}>")

    def form(self) -> None:
        outer = self.chance(0.5)
        if outer:
            self.raw(f"<div{self.named('newsletter', 'subscribe', 'signup', 'search', 'login')}>")
        self.raw("<form action='/go'>")
        if self.chance(0.7):
            self.block("p", self.sentences(1, 2), False)
        for _ in range(self.pick.randint(1, 3)):
            self.block("div", f"<label>{self.words(1, 3)}</label><input name='a'>", False)
        if self.chance(0.5):
            self.block("div", f"<button>{self.words(1, 2)}</button>", False)
        self.raw("</form>" + "</div>" * outer)

    def share(self) -> None:
        self.block("div", " ".join(self.link(self.words(1, 1)) for _ in range(3)), False, self.named("share", "social", "share-bar"))

    def comments(self) -> None:
        tag = self.pick.choice(("section", "div"))
        self.raw(f"<{tag}{self.named('comments', 'discussion', 'reader-comments', 'replies', 'respond')}>")
        if self.chance(0.7):
            self.block(self.pick.choice(("h2", "h3", "h4")), self.words(1, 4), False)
        inner, attributes = self.pick.choice([("div", ' class="comment"'), ("article", ' class="comment"'), ("li", ""), ("div", ""), ("blockquote", "")])
        for _ in range(self.pick.randint(1, 6)):
            self.raw(f"<{inner}{attributes}>")
            if self.chance(0.6):
                self.block(self.pick.choice(("h4", "div", "p")), self.words(1, 2), False)
            for _ in range(self.pick.randint(1, 3)):
                self.block("p", self.sentences(), False)
            self.raw(f"</{inner}>")
        if self.chance(0.3):
            self.form()
        self.raw(f"</{tag}>")

    # The article.

    def paragraph(self) -> None:
        text = self.sentences()
        if self.chance(0.2):
            text += " " + self.link(self.words(1, 3)) + " " + self.sentences(1, 2)
        if self.chance(0.1):
            text = f"<b>{text}"
        self.block("p", text, True)

    def body(self) -> None:
        kind = self.pick.random()
        if kind < 0.08:
            self.block("p", self.pick.choice(SOUNDS_LIKE), True)
        elif kind < 0.75:
            self.paragraph()
        elif kind < 0.82:
            self.block(self.pick.choice(("h2", "h3", "h4")), self.words(1, 8), True)
        elif kind < 0.87:
            tag = self.pick.choice(("ul", "ol"))
            self.raw(f"<{tag}>")
            for _ in range(self.pick.randint(2, 5)):
                self.block("li", self.words(1, 14, self.pick.choice(("", "."))), True)
            self.raw(f"</{tag}>")
        elif kind < 0.91:
            self.raw("<blockquote>")
            self.block("p", self.sentences(), True)
            self.raw("</blockquote>")
        elif kind < 0.94:
            self.block("pre", self.words(2, 20), True)
        elif kind < 0.97:
            self.raw("<table>")
            for _ in range(self.pick.randint(1, 3)):
                self.raw("<tr>")
                for _ in range(2):
                    self.block("td", self.words(1, 5), True)
                self.raw("</tr>")
            self.raw("</table>")
        else:
            self.block("div", self.sentences(), True)

    def article(self) -> None:
        outer = self.chance(0.3)
        if outer:
            self.raw("<main>" if self.chance(0.5) else f"<div{self.named('content', 'main', 'page', 'wrapper', 'container')}>")
        tag, attributes = self.pick.choice(
            [("article", ""), ("article", ""), ("article", self.named("post", "story")), ("div", self.named("article", "content", "post", "entry-content", "story-body")), ("main", ""), ("section", self.named("article-body", "content"))]
        )
        self.raw(f"<{tag}{attributes}>")
        if self.chance(0.8):
            self.block("h1" if self.chance(0.9) else "h2", self.words(1, 12, self.pick.choice(("", "."))), True)
        for _ in range(self.pick.randint(1, 14)):
            self.body()
            if self.chance(0.06):
                self.pick.choice((self.advert, self.side, self.share, self.form, self.notice))()
        if self.chance(0.15):
            self.share()
        late = self.chance(0.25)
        if late and self.chance(0.5):
            self.comments()
            late = False
        self.raw(f"</{tag}>")
        if late:
            self.comments()
        if outer:
            self.raw("</main></div>")

    def page(self) -> Page:
        self.raw(f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style></head><body>")
        for part, p in ((self.notice, 0.2), (self.top, 0.4), (self.menu, 0.7), (self.form, 0.1), (self.advert, 0.4), (self.side, 0.15)):
            if self.chance(p):
                part()
        if self.chance(0.97):
            self.article()
        for part, p in ((self.advert, 0.2), (self.comments, 0.1), (self.side, 0.3), (self.form, 0.1), (self.menu, 0.1), (self.bottom, 0.8), (self.notice, 0.1)):
            if self.chance(p):
                part()
        self.raw("<script>var t='<p>x</p>';</script></body></html>")
        return Page("".join(self.parts), self.labels)


def labelled_pages(n: int, first_seed: int = 0) -> list[Page]:
    return [Writer(first_seed + i).page() for i in range(n)]
