"""Text transforms as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regex class, written so that Java and RE2 read it alike.
_WIDE = "\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[\t-\r{_WIDE}]"

# The seven marks of Markdown text.
MARKDOWN_MARKS = (
    rf"^#{WS}+",
    r"\*\*.*?\*\*",
    r"\*.*?\*",
    r"\[.*?\]\(.*?\)",
    r"```.*?```",
    rf"^{WS}*[-*+]{WS}+",
    rf"^{WS}*\p{{Nd}}+\.{WS}+",
)

# The four Markdown clean-up rewrites, applied in this order.
NORMALIZE_RULES = (
    (rf"\n{WS}*\n{WS}*\n", r"\n\n"),
    (rf"(?m)^({WS}*)(#{{1,6}}){WS}*", r"\1\2 "),
    (rf"(?m)^({WS}*)([-*+]){WS}*", r"\1\2 "),
    (rf"```{WS}*\n", r"```\n"),
)

# HTML to Markdown, applied in this order.
HTML_RULES = (
    (r"(?is)<!--.*?-->", ""),
    (r"(?is)<script\b.*?</script>", ""),
    (r"(?is)<style\b.*?</style>", ""),
    (r"(?is)<head\b.*?<title\b[^>]*>(.*?)</title>.*?</head>", r"# \1\n\n"),
    (r"(?is)<head\b.*?</head>", ""),
    *((rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}>", r"\n\n" + "#" * n + r" \1\n\n") for n in range(1, 7)),
    (r'(?is)<a\b[^>]*href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>', r"[\2](\1)"),
    (r"(?is)<a\b[^>]*href\s*=\s*'([^']*)'[^>]*>(.*?)</a>", r"[\2](\1)"),
    (r"(?is)<(?:b|strong)>(.*?)</(?:b|strong)>", r"**\1**"),
    (r"(?is)<(?:i|em)>(.*?)</(?:i|em)>", r"*\1*"),
    (r"(?is)<li\b[^>]*>", r"\n* "),
    (r"(?is)<br\b[^>]*>", r"\n"),
    (r"(?is)</?(?:p|div|ul|ol|article|section|nav|table|tr)\b[^>]*>", r"\n\n"),
    (r"(?is)<[^>]+>", ""),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&(?:#39|#x27|apos|rsquo|lsquo|#8217|#8216);", "'"),
    ("&(?:ldquo|rdquo|#8220|#8221|#34);", '"'),
    ("&(?:nbsp|#160|#xa0);", " "),
    ("&(?:ndash|#8211);", "–"),
    ("&(?:mdash|#8212);", "—"),
    ("&(?:hellip|#8230);", "…"),
    ("&(?:middot|#183);", "·"),
    ("&(?:copy|#169);", "©"),
    ("&(?:reg|#174);", "®"),
    ("&(?:euro|#8364);", "€"),
    ("&amp;", "&"),
)

# One token: a single Han character, or a run without blanks, punctuation or symbols.
# Common letters stand first in the class, where they are matched fastest.
TOKEN = rf"[a-z0-9à-öø-ÿ[^\t-\r{_WIDE}\p{{P}}\p{{S}}\p{{IsHan}}]]+|\p{{IsHan}}"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def pieces(text: Column, pattern: str) -> Column:
    """Split on a regex, strip each piece, drop the blank ones."""
    parts = F.transform(F.split(text, pattern), strip)
    return F.filter(parts, lambda p: p != "")


def rewrite(text: Column, rules) -> Column:
    """Apply ``(pattern, replacement)`` pairs in order; ``\\1`` names a group."""
    for pattern, replacement in rules:
        java = re.sub(r"\\(\d)", r"$\1", replacement).replace(r"\n", "\n")
        # (?d): only \n ends a line, as in the other engines
        text = F.regexp_replace(text, F.lit("(?d)" + pattern), F.lit(java))
    return text


def normalize_markdown(text: Column) -> Column:
    return strip(rewrite(text, NORMALIZE_RULES))


def html_to_markdown(html: Column) -> Column:
    return normalize_markdown(rewrite(html, HTML_RULES))


def is_markdown(text: Column) -> Column:
    return text.rlike("(?md)" + "|".join(MARKDOWN_MARKS))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def span_markdown(text: Column, size: Column, flags: Column) -> Column:
    """A styled span as Markdown: headings by font size, else emphasis by flag bit."""

    def has(bit: int) -> Column:
        return flags.bitwiseAND(1 << bit) != 0

    styled = text
    for bit, left, right in ((4, "**", "**"), (1, "*", "*"), (2, "<u>", "</u>")):
        styled = F.when(has(bit), F.concat(F.lit(left), styled, F.lit(right))).otherwise(styled)
    return (
        F.when(is_blank(text), text)
        .when(size >= 16, F.concat(F.lit("### "), text))
        .when(size >= 14, F.concat(F.lit("#### "), text))
        .when(size >= 12, F.concat(F.lit("##### "), text))
        .otherwise(styled)
    )


def document_title(first_page: Column, meta_title: Column | None = None) -> Column:
    """The stated title, else the first line of 1 to 99 characters after stripping."""
    lines = pieces(first_page, "\n")
    found = F.get(F.filter(lines, lambda s: F.length(s) < 100), 0)
    if meta_title is None:
        return found
    return F.coalesce(F.when(meta_title != "", meta_title), found)


def extract_block(text: Column, lang: str = "python") -> Column:
    """The fenced or tagged block a reply starts with; any other text as it is."""
    name = re.escape(lang)
    fence, tag = f"(?s)```{name}\n(.*?)\n```", f"(?s)<{name}>\n(.*?)\n</{name}>"
    tagged = text.startswith(lang) | text.startswith(f"<{lang}>")
    return (
        F.when(text.startswith(f"```{lang}") & text.rlike(fence), F.regexp_extract(text, fence, 1))
        .when(tagged & text.rlike(tag), F.regexp_extract(text, tag, 1))
        .otherwise(text)
    )


def parse_object(text: Column, fields: dict[str, str]) -> Column:
    """JSON text as a struct; null unless every field is present and fits its type.

    ``fields`` maps a name to ``string`` or ``number``. A number may arrive as
    numeric text; a string must be a string.
    """
    value = F.try_parse_json(extract_block(text, "json"))
    parsed, fits = [], F.lit(True)
    for name, kind in fields.items():
        path = f"$['{name}']"
        found = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
        if kind == "string":
            parsed.append(F.try_variant_get(value, path, "string").alias(name))
            fits &= found == "STRING"
        else:
            parsed.append(F.try_variant_get(value, path, "double").alias(name))
            fits &= parsed[-1].isNotNull() & (found != "BOOLEAN")
    return F.when(F.coalesce(fits, F.lit(False)), F.struct(*parsed))
