"""String expressions shared by parsers, signals and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: terminal colour codes and leading ISO timestamps of log lines.
ANSI_CODE = r"\u001b\[[0-9;]*[A-Za-z]"
LOG_TIME = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\s*"


# The characters that count as whitespace at the ends of a text.
WHITESPACE = ("\t\n\u000b\f\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004"
              "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(text: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.trim(text, F.lit(WHITESPACE))


def clip(text: Column, limit: int, keep: int) -> Column:
    """Text longer than `limit` characters becomes its first `keep` plus an ellipsis."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, keep), F.lit("..."))) \
            .otherwise(text)


def field(body: Column, name: str) -> Column:
    """Value of a `- **name**: value` line, or an empty string.

    Only blanks of the same line are skipped, so an empty field stays empty.
    """
    return strip(F.regexp_extract(body, rf"(?d)- \*\*{name}\*\*:[^\S\n]*(.*)", 1))


def clean_log(text: Column) -> Column:
    """A log line without colour codes and timestamps."""
    plain = F.when(text.contains("\u001b"), F.regexp_replace(text, ANSI_CODE, "")).otherwise(text)
    return strip(F.regexp_replace(plain, LOG_TIME, ""))


def mask_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\d+", "#")


def words(text: Column) -> Column:
    """Distinct lower-case search words.

    camelCase is searched both joined and split, hyphenated names and path-like test ids
    both whole and in parts.
    """
    split_camel = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    pieces = F.concat(
        F.split(F.lower(text), "[^a-z0-9]+"),
        F.split(F.lower(split_camel), "[^a-z0-9]+"),
        F.split(F.lower(text), "[^a-z0-9-]+"),
        F.split(F.lower(text), "[ ,;()]+"))
    return F.array_distinct(F.filter(pieces, lambda w: w != ""))
