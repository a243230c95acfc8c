"""Native column functions on statement texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The commands that capture leaves out.
META_COMMANDS = (
    "discard begin start commit rollback savepoint release set reset show listen unlisten notify checkpoint vacuum analyze reindex cluster explain prepare deallocate execute close fetch move lock"
).split()
_META = rf"(?iU)^\s*(?:{'|'.join(META_COMMANDS)})(?!\w)"
# Possessive: a long string literal must not exhaust the stack of the JVM.
_STRING = r"'[^']*+(?:''[^']*+)*+'?"


def is_meta(query: Column) -> Column:
    """Whether a statement begins with a meta command; null for null."""
    return query.rlike(_META)


def fingerprint_of(shape: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.substring(F.sha1(shape.cast("binary")), 1, 16))


def rewrite_params(sql: Column) -> Column:
    """``$N`` as ``:paramN``, inside string literals too."""
    return F.regexp_replace(sql, r"\$(\d+)", ":param$1")


def max_param_number(sql: Column) -> Column:
    """The highest ``$N`` outside single-quoted strings; numbers beyond int are ignored."""
    found = F.regexp_extract_all(F.regexp_replace(sql, _STRING, " "), F.lit(r"\$(\d+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, lambda x: x.try_cast("int"))), F.lit(0))


def stub_slug(rank: Column, fingerprint: Column) -> Column:
    """``q03-0123abcd``: rank and the first 8 digits of the fingerprint."""
    return F.format_string("q%02d-%s", rank, F.substring(F.regexp_replace(fingerprint, "^sha1:", ""), 1, 8))
