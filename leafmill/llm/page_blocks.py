"""Leaf blocks of a web page with the features that tell articles from the rest.

A leaf block is the text between two block-level tags. Scripts, styles, comments and
other content that a browser does not show as text give no blocks.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Element kinds.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary"
    " table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style noscript template iframe textarea svg title object video audio canvas math".split())
ENDS_P = BLOCK - {"body", "html", "head", "option", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "dd", "dt", "li"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tr": {"table"}, "option": {"select"}}

# Words in class, id and role that hint at a block's purpose.
HINTS = {
    "menu": "nav navbar navigation navi menu menubar breadcrumb breadcrumbs tabs toc pagination pager skip sitemap",
    "header": "header head masthead banner topbar top branding logo brand tagline",
    "footer": "footer foot bottom colophon copyright legal contentinfo imprint credits",
    "side": "sidebar side aside widget widgets related complementary trending popular recommended rail teaser more",
    "advert": "ad ads advert adverts advertisement advertising adsense banner728 sponsor sponsored promo promotion partner",
    "notice": "cookie cookies consent notice notification alert alertdialog popup modal overlay dialog gdpr disclaimer paywall",
    "form": "form subscribe subscription newsletter signup login register search searchbox poll survey contact",
    "comment": "comment comments commentlist reply replies respond discussion discuss disqus feedback reviews",
    "share": "share sharing social follow tweet facebook tags meta byline",
    "content": "article content post entry story body text main maincontent articlebody postbody page read",
}
CUES = {
    "cookie": "cookie cookies",
    "join": "subscribe newsletter abonnieren abonnez suscríbete sign",
    "comment": "comment comments reply kommentar kommentare commentaire commentaires comentario comentarios",
    "advert": "advertisement sponsored anzeige werbung publicité publicidad",
    "rights": "© copyright rights impressum datenschutz mentions privacy terms",
    "act": "login log search menu share home click share skip accept",
}
TAGS = (
    "article main section nav header footer aside form fieldset ul ol li dl table td th h1 h2 h3 h4 h5 h6 p blockquote"
    " pre figure figcaption button label select dialog details address div"
).split()
NAMES = (
    [f"in {t}" for t in TAGS]
    + [f"hint {h}" for h in HINTS]
    + [f"last hint {h}" for h in HINTS]
    + ["hidden", "last hint none"]
    + [f"words {k}" for k in ("1-2", "3-5", "6-10", "11-20", "21-50", "more")]
    + [f"links {k}" for k in ("none", "few", "many", "all")]
    + [f"cue {c}" for c in CUES]
    + ["sentence", "capitals", "after h1", "short in link list"]
)
AT = {name: i for i, name in enumerate(NAMES)}
_TAG_BIT = {t: 1 << AT[f"in {t}"] for t in TAGS}
_WORD_HINT = {w: h for h, words in HINTS.items() for w in words.split()}
_LAST = sum(1 << AT[f"last hint {h}"] for h in HINTS) | 1 << AT["last hint none"]
_CUE = {w: 1 << AT[f"cue {c}"] for c, words in CUES.items() for w in words.split()}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+\d*|[A-Z]+")
_CLOSERS = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in UNSEEN}


@dataclass
class Block:
    text: str
    features: int  # bits by AT


def _hinted(mask: int, attributes: str) -> int:
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "none" in value:
            mask |= 1 << AT["hidden"]
        elif name != "style":
            for word in _WORDS.findall(value):
                hint = _WORD_HINT.get(word.lower())
                if hint:
                    mask = (mask | 1 << AT[f"hint {hint}"]) & ~_LAST | 1 << AT[f"last hint {hint}"]
    return mask


def _text_features(words: list[str], text: str, linked: int) -> int:
    n = len(words)
    size = "1-2" if n < 3 else "3-5" if n < 6 else "6-10" if n < 11 else "11-20" if n < 21 else "21-50" if n < 51 else "more"
    share = linked / max(1, len(text))
    links = "none" if linked == 0 else "few" if share < 0.4 else "many" if share < 0.9 else "all"
    mask = 1 << AT[f"words {size}"] | 1 << AT[f"links {links}"]
    if text[-1] in ".!?…:»”\"":
        mask |= 1 << AT["sentence"]
    if text.isupper():
        mask |= 1 << AT["capitals"]
    for word in words[:30]:
        mask |= _CUE.get(word.lower().strip(".,:;!"), 0)
    return mask


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order; character references are decoded and white
    space inside a block is one space."""
    found: list[Block] = []
    stack: list[tuple[str, int]] = []
    runs: list[str] = []
    linked = links_open = after_title = 0
    place = 0
    root = 1 << AT["last hint none"]

    def close() -> None:
        nonlocal linked, after_title
        if runs:
            words = html.unescape("".join(runs)).split()
            if words:
                text = " ".join(words)
                mask = place | _text_features(words, text, linked) | after_title
                if mask & _TAG_BIT["li"] and mask >> AT["links all"] & 1:
                    mask |= 1 << AT["short in link list"]
                if mask & _TAG_BIT["h1"]:
                    after_title = 1 << AT["after h1"]
                found.append(Block(text, mask))
            runs.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked, place
        if piece:
            if not runs or not place and piece.strip():
                place = stack[-1][1] if stack else root
            runs.append(piece)
            if links_open:
                linked += len(piece.strip())

    def drop(depth: int) -> None:
        nonlocal links_open
        while len(stack) > depth:
            links_open -= stack.pop()[0] == "a"

    at = 0
    while True:
        m = _MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        if tag in BLOCK:
            close()
        elif tag == "br":
            add(" ")
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    drop(depth)
                    break
            continue
        if tag in UNSEEN:
            if not m[3].endswith("/"):
                end = _CLOSERS[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in VOID:
            continue
        if tag in ENDS_P:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    drop(depth)
                    break
                if stack[depth][0] in BLOCK:
                    break
        if tag in SIBLINGS:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in SIBLINGS[tag]:
                    drop(depth)
                    break
                if stack[depth][0] in SCOPE[tag]:
                    break
        mask = stack[-1][1] if stack else root
        mask |= _TAG_BIT.get(tag, 0)
        if m[3]:
            mask = _hinted(mask, m[3])
        stack.append((tag, mask))
        links_open += tag == "a"
    close()
    return found
