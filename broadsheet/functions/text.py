"""Cleaning, excerpts, keyword context and counts over article text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.runtime import let

# The white space recognised everywhere, as regex class members and as characters.
SPACE_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE_CODES = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
SPACE_CHARS = "".join(map(chr, SPACE_CODES))
# Line ends that close a first line, and replacements for markup characters.
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
MARKUP = (
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&#x27;"),
    ("{", "&#123;"),
    ("}", "&#125;"),
)
WORD = r"[\p{L}\p{N}_]+"
ELLIPSIS = "…"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE_CHARS))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE_CLASS}]+", " ")


def literal_pattern(term: str) -> str:
    """Case-insensitive pattern for a literal term."""
    return "(?iu)\\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"


def contains_term(text: Column, term: str) -> Column:
    """Case-insensitive literal substring; null text is no match."""
    return F.lower(F.coalesce(text, F.lit(""))).contains(F.lower(F.lit(term)))


def join_hyphen_breaks(text: Column) -> Column:
    return F.regexp_replace(text, f"-[{SPACE_CLASS}]+", "")


def page_image_to_pdf(url: Column) -> Column:
    """``.jp2`` in any case, at the end of the path, becomes ``.pdf``."""
    return F.regexp_replace(url, r"(?i)\.jp2(?=\n?$|[?#])", ".pdf")


def escape_markup(text: Column) -> Column:
    for char, entity in MARKUP:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def first_line(text: Column, limit: int | None = 75) -> Column:
    """First line, trimmed; longer lines are cut to ``limit - 1`` characters and an ellipsis."""
    line = strip(F.split(F.coalesce(text, F.lit("")), LINE_END, 2)[0])
    if limit is None:
        return line
    return let(
        line,
        lambda s: F.when(F.length(s) <= limit, s).otherwise(
            F.concat(rstrip(F.substring(s, 1, limit - 1)), F.lit(ELLIPSIS))
        ),
    )


def plain_excerpt(text: Column, limit: int | None = 420) -> Column:
    """Whitespace-collapsed text, cut to ``limit`` characters and an ellipsis."""
    flat = strip(collapse_space(F.coalesce(text, F.lit(""))))
    if limit is None:
        return flat
    return let(
        flat,
        lambda s: F.when(F.length(s) <= limit, s).otherwise(
            F.concat(rstrip(F.substring(s, 1, limit)), F.lit(ELLIPSIS))
        ),
    )


def mark_term(text: Column, term: str) -> Column:
    """Escape markup and wrap each hit of the term in ``<mark>``."""
    if not term.strip(SPACE_CHARS):
        return escape_markup(text)
    pattern = literal_pattern(term.strip(SPACE_CHARS))
    between = F.transform(F.split(text, pattern, -1), escape_markup)
    hits = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda h: F.concat(F.lit("<mark>"), escape_markup(h), F.lit("</mark>")),
    )
    pieces = F.zip_with(between, hits, lambda b, h: F.concat(b, F.coalesce(h, F.lit(""))))
    return F.array_join(pieces, "")


def keyword_context(
    text: Column, term: str, window: int = 60, highlight: bool = True
) -> Column:
    """First hit with ``window`` characters on each side; no hit gives an empty string."""
    word = (term or "").strip(SPACE_CHARS)
    if not word:
        return F.lit("")
    # Splitting at the first hit counts characters, where a match offset counts UTF-16 units.
    halves = F.split(F.coalesce(text, F.lit("")), literal_pattern(word), 2)

    def snippet(parts: Column) -> Column:
        before, after = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        hit = F.substring(
            text,
            F.length(before) + 1,
            F.length(text) - F.length(before) - F.length(after),
        )
        core = collapse_space(
            strip(
                F.concat(F.right(before, F.lit(window)), hit, F.left(after, F.lit(window)))
            )
        )
        return let(
            core,
            lambda c: F.when(c == "", c).otherwise(
                F.concat(
                    F.when(F.length(before) > window, ELLIPSIS).otherwise(""),
                    c,
                    F.when(F.length(after) > window, ELLIPSIS).otherwise(""),
                )
            ),
        )

    found = let(halves, lambda p: F.when(F.size(p) > 1, snippet(p)).otherwise(""))
    return let(found, lambda s: mark_term(s, word)) if highlight else found


def marked_excerpt(text: Column, term: str, limit: int | None = 1200) -> Column:
    return let(plain_excerpt(text, limit), lambda s: mark_term(s, term or ""))


def term_count(text: Column, term: str | None) -> Column:
    """Non-overlapping case-insensitive literal hits; a blank term counts nothing."""
    word = (term or "").strip(SPACE_CHARS)
    if not word:
        return F.lit(0)
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(literal_pattern(word)))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))
