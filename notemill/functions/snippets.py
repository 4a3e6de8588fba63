"""Snippets of the few notes a search returns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..common import WHITE


def snippet(text: str, terms: list[str], window: int = 200) -> str | None:
    """About `window` characters around the earliest term, grown to whole words; None where no term occurs.

    Terms are stems and may match inside a word. White space becomes single blanks; an ellipsis marks a cut side.
    """
    lower = text.lower()
    hits = [(lower.find(t.lower()), len(t)) for t in terms if t]
    hits = [h for h in hits if h[0] >= 0]
    if not hits:
        return None
    at, size = min(hits, key=lambda h: h[0])
    start = max(0, min((2 * at + size) // 2 - window // 2, len(text) - window))
    end = min(len(text), start + window)
    while start > 0 and text[start - 1] not in WHITE:
        start -= 1
    while end < len(text) and text[end] not in WHITE:
        end += 1
    shown = re.sub(f"[{WHITE}]+", " ", text[start:end]).strip(WHITE)
    return ("… " if start > 0 else "") + shown + (" …" if end < len(text) else "")


def snippet_column(text: Column, terms: Column, window: int = 200) -> Column:
    @F.pandas_udf(StringType())
    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else snippet(t, list(f) if f is not None else [], window) for t, f in zip(texts, found)], dtype=object)

    return run(text, terms)
