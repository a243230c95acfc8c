"""Columns that read SQL: Arrow-batched UDFs with a bounded memory of texts seen.

Statement logs repeat their texts, so a worker remembers what it has read. The
UDFs work row by row on whole partitions and need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sqltext import SqlError, canon

ANALYSIS = "parse_ok boolean, canonical string, shape string, error string"
_REMEMBERED_CHARS = 32 << 20


class Memo(dict):
    """Text -> result; starts again once the texts remembered are too long in all."""

    def __init__(self, compute: Callable) -> None:
        self.compute, self.chars = compute, 0

    def __missing__(self, text: str):
        out = self.compute(text)
        if self.chars > _REMEMBERED_CHARS:
            self.clear()
            self.chars = 0
        self.chars += len(text)
        self[text] = out
        return out


def _analyze(text: str | None) -> tuple:
    if text is None:
        return False, None, None, "no text"
    try:
        found = canon.analyze(text)
        return True, found.canonical, found.shape, None
    except SqlError as e:
        return False, text, None, str(e)


def analysis(raw: Column) -> Column:
    """Struct ANALYSIS of a statement text. Unreadable texts are their own canonical form."""

    @F.pandas_udf(ANALYSIS)
    def analyze(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen = Memo(_analyze)
        for batch in texts:
            rows = [seen[x] if isinstance(x, str) else _analyze(None) for x in batch]
            yield pd.DataFrame(rows, columns=["parse_ok", "canonical", "shape", "error"])

    return analyze(raw.cast("string"))


def with_casts(canonical: Column, functions: dict[tuple[str, str, int], list[str] | None]) -> Column:
    """Canonical texts with casts for their parameters; ``functions`` is a catalog lookup."""

    @F.pandas_udf("string")
    def cast(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen = Memo(lambda x: canon.cast_params(x, lambda *key: functions.get(key)))
        for batch in texts:
            yield pd.Series([seen[x] if isinstance(x, str) else None for x in batch], dtype=object)

    return cast(canonical)
