"""Where the outputs of a run go."""

from __future__ import annotations

import hashlib
import json
import re

def safe_name(text: str | None, default: str = "term") -> str:
    """Text as a path part: ASCII letters, digits, ``.``, ``-``; runs of blanks become ``_``."""
    words = ("".join(re.findall(r"[\w.-]", word, re.ASCII)) for word in (text or "").split())
    return "_".join(filter(None, words)) or default


def run_name(term: str, **params) -> str:
    """Readable head and a digest over the term and all parameters that are set.

    Equal parameters give equal names in whatever order they come; ``start`` and ``end`` are shown.
    """
    told = {k: v for k, v in params.items() if v not in (None, "", (), [], {}, False)}
    text = json.dumps({"term": term, **told}, sort_keys=True, default=list)
    digest = hashlib.sha1(text.encode()).hexdigest()[:8]
    head = (safe_name(str(told.get(k, "")), "all") for k in ("start", "end"))
    return "_".join((safe_name(term), *head, digest))


def collocation_paths(out: str, term: str, **params) -> dict[str, str | None]:
    """Paths of a collocation run, known before it starts."""
    name = run_name(term, **params)
    paths = {kind: f"{out}/{kind}_{name}" for kind in ("metrics", "by_time", "occurrences")}
    if not params.get("time_bin"):
        paths["by_time"] = None
    return paths


def search_path(out: str, term: str, start: str, end: str) -> str:
    return f"{out}/{safe_name(term)}_{start}_{end}"
