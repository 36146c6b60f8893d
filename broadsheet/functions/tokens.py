"""Tokens, phrase positions and context windows as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.runtime import let

# The token alphabet and the words dropped on request.
TOKEN = "[A-Za-z0-9']+"
NON_TOKEN = "[^A-Za-z0-9']"
STOPWORDS = tuple(
    """
    a an the this that these those i me my myself we our ours ourselves you your yours
    yourself yourselves he him his himself she her hers herself it its itself they them
    their theirs themselves what which who whom whose someone something one
    am is are was were be been being have has had having do does did doing
    would should could ought may might must can shall will
    and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over
    under again further then once here there when where why how all any both each few
    more most other some such no nor not only own same so than too very s t
    just don now
    '' '
    two three four five six seven eight nine ten
    """.split()
)


def phrase_tokens(term: str, stopwords: Iterable[str] = ()) -> list[str]:
    """Tokens of a search phrase (driver side; a phrase is a handful of words)."""
    drop = set(stopwords)
    found = [t.lower() for t in re.findall(TOKEN, term)]
    kept = [t for t in found if t not in drop]
    if not kept:
        raise ValueError("the search phrase has no token left to look for")
    return kept


def tokens(text: Column, stopwords: Sequence[str] = ()) -> Column:
    """Lower-case tokens in text order; null text gives null.

    Extraction comes first and lower-casing second: lower-casing whole text may turn non-ASCII
    letters into ASCII ones and so create tokens that are not there.
    """
    found = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)
    if not stopwords:
        return found
    drop = list(stopwords)
    return F.filter(found, lambda t: ~t.isin(drop))


def phrase_pattern(phrase: Sequence[str], stopwords: Sequence[str] = ()) -> str:
    """Pattern that finds the token phrase in raw text.

    It matches exactly the rows in which the tokens, after dropping stopwords, contain the phrase,
    so rows without a hit are dropped before anything is tokenized.
    """
    gap = NON_TOKEN + "++"
    if stopwords:
        words = "|".join(re.escape(w) for w in sorted(stopwords, key=lambda w: (-len(w), w)))
        # Possessive: a plain repetition recurses once per stopword and overflows the stack on long runs.
        # It matches the same, as tokens of the phrase are never stopwords.
        gap += f"(?:(?:{words}){gap})*+"
    return f"(?i)(?<!{TOKEN[:-1]})" + gap.join(re.escape(p) for p in phrase) + f"(?!{TOKEN[:-1]})"


def may_have_phrase(text: Column, phrase: Sequence[str]) -> Column:
    """Cheap test that every row with the phrase passes."""
    return F.lower(text).contains(phrase[0])


def has_phrase(text: Column, phrase: Sequence[str], stopwords: Sequence[str] = ()) -> Column:
    """Token-phrase test; the plain substring test in front skips most rows cheaply."""
    return may_have_phrase(text, phrase) & text.rlike(phrase_pattern(phrase, stopwords))


def phrase_starts(toks: Column, phrase: Sequence[str]) -> Column:
    """0-based starts of ``phrase`` in a token array, overlapping hits included.

    ``toks`` should be a bound variable (see ``let``): it is used several times.
    """
    starts = F.array_compact(F.transform(toks, lambda t, i: F.when(t == phrase[0], i)))
    if len(phrase) == 1:
        return starts
    wanted = F.array(*[F.lit(p) for p in phrase])
    return F.filter(starts, lambda i: F.slice(toks, i + 1, len(phrase)) == wanted)


def _around(toks: Column, start: Column, length: int, window: int) -> Column:
    before = F.least(start, F.lit(window))
    return F.concat(
        F.slice(toks, start - before + 1, before), F.slice(toks, start + length + 1, window)
    )


def neighbours(
    toks: Column, phrase: Sequence[str], window: int, with_position: bool = False
) -> Column:
    """All tokens within ``window`` places of every hit, as one flat array per row.

    With positions the elements are ``struct(term, rel)``: -k..-1 on the left, 0, 1, ... on the
    right. One flat array means one explode, whose rows never carry the token array along.
    """
    n = len(phrase)

    def context(toks: Column, start: Column) -> Column:
        around = _around(toks, start, n, window)
        if not with_position:
            return around
        left = F.least(start, F.lit(window))
        return F.transform(
            around, lambda t, j: F.struct(t.alias("term"), (j - left).alias("rel"))
        )

    return let(
        toks,
        lambda t: F.flatten(F.transform(phrase_starts(t, phrase), lambda st: context(t, st))),
    )


def is_number(token: Column) -> Column:
    return token.rlike("^[0-9]+$")
