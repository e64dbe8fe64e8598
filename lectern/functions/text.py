"""Folding, white space, markup."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_text(s: str) -> str:
    """Without accents and case: compatibility decomposition, combining marks dropped, casefold."""
    return s.lower() if s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()


def fold(column: Column) -> Column:
    """fold_text() over a string column; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(fold_text, na_action="ignore")

    return run(column)


def fold_all(column: Column) -> Column:
    """fold_text() over each value of an array of strings."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda a: [None if x is None else fold_text(x) for x in a], na_action="ignore")

    return run(column)


def strip(column: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def collapse(column: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(column, r"(?U)\s+", " "))


def plain_text(column: Column, entities: tuple[str, ...] | None = None) -> Column:
    """Markup as plain text: script and style go with what they hold, tags go, entities are decoded, no-break blanks become
    blanks, and the ends are stripped. Entities are all of HTML's, some of which need no semicolon, as in a browser; or only
    those with the names given, each with its semicolon."""
    named = None if entities is None else re.compile(f"&(?:{'|'.join(map(re.escape, entities))});")

    def decode(x: str) -> str:
        return named.sub(lambda m: html.unescape(m[0]), x) if named else html.unescape(x)

    @F.pandas_udf("string")
    def decoded(s: pd.Series) -> pd.Series:
        return s.map(lambda x: decode(x).replace("\xa0", " ").strip(), na_action="ignore")

    bare = F.regexp_replace(F.regexp_replace(column, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]+>", " ")
    return decoded(bare)


def title_case(column: Column) -> Column:
    """Each run of letters with a capital first and small letters after it, whatever stands before the run."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(str.title, na_action="ignore")

    return run(column)


def from_octal(column: Column) -> Column:
    """Text with its bytes beyond ASCII written as a backslash and three octal digits, as UTF-8 again; what is no UTF-8 becomes
    the replacement character."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: re.sub(rb"\\([0-3][0-7]{2})", lambda m: bytes([int(m[1], 8)]), x.encode()).decode(errors="replace"), na_action="ignore")

    return run(column)


def check_pattern(pattern: str) -> None:
    """Raises re.error if the pattern is no regular expression."""
    re.compile(pattern, re.IGNORECASE)
