"""Scalars for listings: stars, author names, series labels, bars, sizes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def stars(raw: Column) -> Column:
    """Half of a rating out of ten; null if there is none, or if it is 0."""
    return F.when(raw.isNull() | (raw == 0), None).otherwise(raw / 2)


def star_text(rating: Column) -> Column:
    """Filled, half and empty stars, five at most; null without a rating."""
    held = F.least(F.greatest(rating, F.lit(0.0)), F.lit(5.0))
    full = F.floor(held).cast("int")
    half = ((held - full) >= 0.5).cast("int")
    return F.when(rating.isNotNull(), F.concat(F.repeat(F.lit("★"), full), F.repeat(F.lit("½"), half), F.repeat(F.lit("☆"), 5 - full - half)))


def star_suffix(rating: float | None) -> str:
    """The same in a listing, with the number; rendered on the driver, where numbers round as in print."""
    if not rating:
        return ""
    held = min(5.0, max(0.0, rating))
    full, half = int(held), held - int(held) >= 0.5
    return f" [{'★' * full}{'½' * half}{'☆' * (5 - full - half)} {rating:.1f}/5]"


def author_display(authors: Column) -> Column:
    return F.when(F.size(authors) > 0, F.array_join(authors, " & ")).otherwise("Unknown Author")


def primary_author(authors: Column) -> Column:
    return F.coalesce(F.get(authors, F.lit(0)), F.lit("Unknown Author"))


def author_key(author_sort: Column) -> Column:
    """Lower-cased, up to the first &."""
    return F.trim(F.lower(F.substring_index(F.coalesce(author_sort, F.lit("")), "&", 1)))


def series_label(index: Column) -> Column:
    """#3 for a whole number, #3.5 for another, nothing for none."""
    return F.when(index == F.floor(index), F.concat(F.lit("#"), F.floor(index).cast("string"))).when(index.isNotNull(), F.concat(F.lit("#"), index.cast("string")))


def branch(tag: Column, levels: int = 2) -> Column:
    """The first levels of a dotted tag."""
    return F.coalesce(F.when(tag != "", F.substring_index(tag, ".", levels)), F.lit("(untagged)"))


def bar(n: Column, total: Column, width: int = 40) -> Column:
    """A bar that is full when n is all of total: the sum of a breakdown, or its largest part."""
    return F.repeat(F.lit("█"), F.coalesce(F.floor(F.try_divide(n * width, total)).cast("int"), F.lit(0)))


def share_bar(hits: Column, total: Column, width: int = 20) -> Column:
    """A bar of a rate, rounded to the nearest mark, halves to the even one."""
    return F.repeat(F.lit("#"), F.coalesce(F.bround(F.try_divide(hits * width, total)).cast("int"), F.lit(0)))


def value_suffix(name: str, value: Column) -> Column:
    """A custom value behind a line, as ` <name: value>`; nothing where there is none, or where it is blank, false or 0."""
    text = F.nullif(value.cast("string"), F.lit(""))
    return F.coalesce(F.when(~text.isin("0", "0.0", "false"), F.concat(F.lit(f" <{name}: "), text, F.lit(">"))), F.lit(""))


def wrap(text: str | None, width: int = 96, indent: str = "  ") -> str:
    """Words in lines of width characters at most, but for a word that is longer by itself."""
    words = (text or "").split()
    lines: list[str] = words[:1]
    for word in words[1:]:
        if len(lines[-1]) + 1 + len(word) <= width:
            lines[-1] += f" {word}"
        else:
            lines.append(word)
    return "\n".join(indent + line for line in lines or ["(empty)"])


def wrapped(text: Column, width: int = 96) -> Column:
    """wrap() over a column."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: wrap(t, width))

    return run(text)


def human_size(n: Column) -> Column:
    return F.when(n >= 1 << 30, F.concat(F.format_number(n / (1 << 30), 2), F.lit(" GB"))).when(n >= 1 << 20, F.concat(F.format_number(n / (1 << 20), 1), F.lit(" MB"))).otherwise(F.concat(F.format_number(n / 1024, 0), F.lit(" KB")))
