"""From syntax trees to Catalyst predicates.

Negation is pushed down to the terms first. A term that stands bare may be null, which drops the row; a negated one becomes
`value is null or not term`, so that both forms reach the scan as pushed filters. Values are checked when a search is compiled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.dates import UNDEFINED, day_of
from lectern.functions.text import fold_text
from lectern.plans.fields import ALIASES, ALL_FIELDS, FieldRegistry
from lectern.plans.syntax import And, Node, Not, Or, SearchError, Term, parse

_YES, _NO = ("true", "yes"), ("false", "no")
_SIZES = {"k": 1024.0, "m": 1024.0**2, "g": 1024.0**3}
_RELATIONS = ("!=", ">=", "<=", "=", ">", "<")


@dataclass(frozen=True)
class Match:
    """How a text is compared: contains, equals, regex or accent."""

    how: str
    text: str

    @staticmethod
    def of(value: str) -> Match:
        """A first =, ~ or ^ names the way, and a backslash takes such a meaning away; alone they are text."""
        how = {"=": "equals", "~": "regex", "^": "accent", "\\": "contains"}.get(value[:1]) if len(value) > 1 else None
        return Match(how, value[1:]) if how else Match("contains", value)


def _java_takes(pattern: str) -> bool:
    """Whether Spark's own regular expressions, which are Java's, read the pattern."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(f"(?iuU){pattern}")
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def negate(tree: Node, flip: bool = False) -> Node:
    """The tree with Not on terms only."""
    if isinstance(tree, Not):
        return negate(tree.inner, not flip)
    if isinstance(tree, Term):
        return Not(tree) if flip else tree
    joined = Or if isinstance(tree, And) == flip else And
    return joined(negate(tree.left, flip), negate(tree.right, flip))


def split_relation(value: str) -> tuple[str, str]:
    """The relation at the start of a value, = if none, and the rest."""
    found = next((r for r in _RELATIONS if value.startswith(r)), "")
    return found or "=", value[len(found) :]


def relate(column: Column, relation: str, value) -> Column:
    return {"!=": column != value, ">=": column >= value, "<=": column <= value, "=": column == value, ">": column > value, "<": column < value}[relation]


def date_range(text: str, as_of: date) -> tuple[date, date]:
    """The days [first, after) that a year, a month, a day or a word for one covers."""
    word = text.lower().lstrip("_") if text.lower() in ("today", "_today", "yesterday", "_yesterday", "thismonth", "_thismonth") else text.lower()
    if word in ("today", "yesterday"):
        first = as_of - timedelta(days=word == "yesterday")
        return first, first + timedelta(days=1)
    if ago := re.fullmatch(r"(\d+)\s*(?:days?ago|_daysago)", word):
        first = as_of - timedelta(days=int(ago[1]))
        return first, first + timedelta(days=1)
    try:
        parts = [as_of.year, as_of.month] if word == "thismonth" else [int(p) for p in text.split("-")][:3]
        first = date(*(parts + [1, 1])[:3])
        if len(parts) == 3:
            return first, first + timedelta(days=1)
        if len(parts) == 2:
            return first, date(first.year + first.month // 12, first.month % 12 + 1, 1)
        return first, date(first.year + 1, 1, 1)
    except (ValueError, OverflowError) as e:
        raise SearchError(f"no date: {text!r}") from e


class Compiler:
    """Compiles searches for one table of items. Without a folded copy of a text column (with_folded()), plain lower case is
    compared, which is the same for values without accents."""

    def __init__(self, items: DataFrame, registry: FieldRegistry | None = None, as_of: date | None = None):
        self.columns, self.kinds, self.registry, self.as_of = set(items.columns), dict(items.dtypes), registry or FieldRegistry(), as_of or date.today()

    def predicate(self, text: str) -> Column:
        """The rows that an expression finds, as a condition for a filter; a blank one finds all."""
        return F.lit(True) if not text.strip() else self._column(negate(parse(text.strip(), self.registry.names())), frozenset())

    def flag(self, text: str) -> Column:
        """The same as a value that is never null."""
        return F.coalesce(self.predicate(text), F.lit(False))

    def _column(self, tree: Node, seen: frozenset[str]) -> Column:
        if isinstance(tree, (And, Or)):
            left, right = self._column(tree.left, seen), self._column(tree.right, seen)
            return left & right if isinstance(tree, And) else left | right
        term, flip = (tree.inner, True) if isinstance(tree, Not) else (tree, False)
        if ALIASES.get(term.field, term.field) == "vl":
            return self._view(term.value, flip, seen)
        found, nullable = self._term(term)
        if not flip:
            return found
        return ~found if nullable is None else nullable.isNull() | ~found

    def _view(self, name: str, flip: bool, seen: frozenset[str]) -> Column:
        """A named view's expression in place of its name. Names are looked up as written; a view in itself is an error."""
        if name.lower() in seen:
            raise SearchError(f"view {name!r} refers to itself")
        body = self.registry.views.get(name)
        if body is None:
            return F.lit(flip)
        return self._column(negate(parse(body.strip(), self.registry.names()), flip), seen | {name.lower()})

    def _term(self, term: Term) -> tuple[Column, Column | None]:
        """A term's condition, and the column whose null makes it null (None: it is never null)."""
        name = ALIASES.get(term.field, term.field)
        if name == "all":
            return self._anywhere(term.value), None
        kind, column = self.registry.kind(name), self.registry.column(name)
        value = term.value.lower().strip()
        if kind == "identifiers":
            return self._identifiers(column, f"=isbn:{term.value}" if term.field == "isbn" else term.value), None
        if kind == "bool":
            own = F.coalesce(F.col(column).cast("boolean"), F.lit(False)) if column in self.columns else F.lit(False)
            return (own if value in _YES else ~own if value in _NO else F.lit(False)), None
        if kind in ("int", "float", "rating"):
            return self._number(column, kind, value)
        if kind == "date":
            return self._date(column, value)
        return self._text(column, kind, term.value), None

    # Numbers and dates

    def _number(self, column: str, kind: str, value: str) -> tuple[Column, Column | None]:
        # A value that is no number is none, and does not end the job.
        own = (F.col(column) if column in self.columns else F.lit(None)).try_cast("long" if kind == "int" else "double")
        if value in ("true", "false"):
            has = own.isNotNull() & (own > 0) if kind == "rating" else own.isNotNull()
            return (F.coalesce(has, F.lit(False)) if value == "true" else own.isNull() | (own == 0) if kind == "rating" else own.isNull()), None
        relation, text = split_relation(value)
        times = _SIZES.get(text[-1:]) if len(text) > 1 else None
        try:
            number = int(text[:-1] if times else text) if kind == "int" else float(text[:-1] if times else text)
        except ValueError as e:
            raise SearchError(f"no number: {text!r}") from e
        return relate(own, relation, number * times if times else number), own

    def _date(self, column: str, value: str) -> tuple[Column, Column | None]:
        own = day_of(F.col(column)) if column in self.columns else F.lit(None).cast("date")
        if column in self.columns and f"{column}_day" in self.columns:
            own = F.col(f"{column}_day")
        elif self.kinds.get(column, "").startswith(("date", "timestamp")):
            # The bare column between days, which a scan can take over; days that stand for an unknown date are left out.
            own = F.col(column)
            if value not in _NO + _YES and value:
                relation, text = split_relation(value)
                first, after = date_range(text.strip(), self.as_of)
                day = lambda d: F.lit(d.isoformat()).cast("date")
                unknown = [date.fromisoformat(x) for x in UNDEFINED]
                known = reduce(lambda a, b: a & b, ((own < day(x)) | (own >= day(x + timedelta(1))) for x in unknown))
                least, most = day(first), day(after)
                found = {"=": (own >= least) & (own < most), "!=": (own < least) | (own >= most), ">": own >= most, ">=": own >= least, "<": own < least, "<=": own < most}[relation]
                return found & known, day_of(own)
            own = day_of(own)
        if value in _NO or not value:
            return own.isNull(), None
        if value in _YES:
            return own.isNotNull(), None
        relation, text = split_relation(value)
        first, after = date_range(text.strip(), self.as_of)
        if relation in ("=", "!="):
            inside = (own >= first) & (own < after)
            return inside if relation == "=" else (own < first) | (own >= after), own
        return {">": own >= after, ">=": own >= first, "<": own < first, "<=": own < after}[relation], own

    # Texts

    def _values(self, column: str, kind: str | None, folded: bool) -> Column:
        """A field's values that are neither null nor empty, as an array."""
        if column not in self.columns:
            return F.array().cast("array<string>")
        own = F.col(f"{column}_f") if folded and f"{column}_f" in self.columns else F.col(column)
        if kind not in ("multi", "tree"):
            own = F.array(own.cast("string"))
        if folded and f"{column}_f" not in self.columns:
            own = F.transform(own, F.lower)
        return F.filter(F.coalesce(own, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))

    @staticmethod
    def _regex(column: Column, pattern: str) -> Column:
        """Whether some value has a match, whatever the case."""
        try:
            re.compile(pattern, re.IGNORECASE)
        except re.error as e:
            raise SearchError(f"no regular expression: {pattern!r}") from e
        for text in dict.fromkeys((pattern, re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<")))):
            if _java_takes(text):
                own = F.lit(f"(?iuU){text}")
                return F.exists(column, lambda x: F.regexp_like(x, own))

        @F.pandas_udf("boolean")
        def found(values: pd.Series) -> pd.Series:  # what only Python's expressions can say
            expression = re.compile(pattern, re.IGNORECASE)
            return pd.Series([any(x is not None and expression.search(x) for x in v) if v is not None else False for v in values])

        return found(column)

    def _plain(self, column: str, kind: str | None, match: Match) -> Column:
        """A text match without regard to trees."""
        if match.how == "regex":
            return self._regex(self._values(column, kind, folded=False), match.text)
        text = fold_text(match.text)
        if kind not in ("multi", "tree") and column in self.columns:
            # One value: a condition that a scan can take over.
            own = F.col(f"{column}_f") if f"{column}_f" in self.columns else F.lower(F.col(column).cast("string"))
            test = own == text if match.how == "equals" else own.contains(text)
            return F.coalesce(test & (own != ""), F.lit(False)) if text == "" else F.coalesce(test, F.lit(False))
        values = self._values(column, kind, folded=True)
        return F.array_contains(values, text) if match.how == "equals" else F.exists(values, lambda x: x.contains(text))

    def _tree(self, column: str, match: Match) -> Column:
        """A match of dotted tags: the tag or what is below it; `=` the tag alone, `=.x` x or below, `=..x` x at any place."""
        if match.how == "regex":
            return self._regex(self._values(column, "tree", folded=False), match.text)
        values, text = self._values(column, "tree", folded=True), fold_text(match.text)
        if match.how == "accent":
            return F.exists(values, lambda x: x.contains(text))
        if match.how == "contains":
            return F.exists(values, lambda x: (x == text) | x.startswith(text + "."))
        if text.startswith(".."):
            return F.exists(values, lambda x: (x == text) | (F.array_contains(F.split(x, r"\."), text[2:]) & (text[2:] != "")))
        if text.startswith("."):
            own = text[1:]
            return F.exists(values, lambda x: (x == own) | x.startswith(own + "."))
        return F.array_contains(values, text)

    def _text(self, column: str, kind: str | None, value: str) -> Column:
        match = Match.of(value)
        if match.how == "contains" and match.text.lower() in _YES + _NO:
            has = F.size(self._values(column, kind, folded=False)) > 0
            return has if match.text.lower() in _YES else ~has
        return self._tree(column, match) if kind == "tree" else self._plain(column, kind, match)

    def _anywhere(self, value: str) -> Column:
        match = Match.of(value)
        return reduce(lambda a, b: a | b, (self._plain(self.registry.column(f), self.registry.kind(f), match) for f in ALL_FIELDS))

    def _identifiers(self, column: str, value: str) -> Column:
        """key:value, either part with a match of its own; a key alone (key:) is there or not; a value alone is of any key."""
        if column not in self.columns:
            entries = F.array().cast("array<struct<k:string,v:string,kf:string,vf:string>>")
        else:
            lowered = F.transform(F.map_entries(column), lambda e: F.struct(F.lower(e["key"]).alias("k"), F.lower(e["value"]).alias("v")))
            folded = F.col(f"{column}_f") if f"{column}_f" in self.columns else lowered
            entries = F.zip_with(F.map_entries(column), folded, lambda e, f: F.struct(e["key"].alias("k"), e["value"].alias("v"), f["k"].alias("kf"), f["v"].alias("vf")))
            entries = F.coalesce(entries, F.array().cast("array<struct<k:string,v:string,kf:string,vf:string>>"))
        key, colon, rest = value.partition(":")
        key, own = (Match.of(key.strip()), Match.of(rest.strip())) if colon else (Match("contains", ""), Match.of(value.strip()))

        def part(entry: Column, which: str, match: Match) -> Column:
            if not match.text:
                return F.lit(True)
            if match.how == "regex":
                return self._regex(F.array(entry[which]), match.text)
            text = fold_text(match.text)
            return entry[which + "f"] == text if match.how == "equals" else entry[which + "f"].contains(text)

        if own.text in _YES + _NO:
            has = F.exists(entries, lambda e: F.coalesce(part(e, "k", key), F.lit(False)))
            return has if own.text in _YES else ~has
        return F.exists(entries, lambda e: F.coalesce(part(e, "k", key) & part(e, "v", own), F.lit(False)))


def fields_of(text: str, registry: FieldRegistry, seen: frozenset[str] = frozenset()) -> set[str]:
    """The fields, by their canonical names, that a search looks at, in the views that it names too."""
    if not text.strip():
        return set()
    found, rest = set(), [parse(text.strip(), registry.names())]
    while rest:
        tree = rest.pop()
        if isinstance(tree, (And, Or)):
            rest += [tree.left, tree.right]
        elif isinstance(tree, Not):
            rest.append(tree.inner)
        elif (name := ALIASES.get(tree.field, tree.field)) == "all":
            found |= set(ALL_FIELDS)
        elif name == "vl":
            if tree.value.lower() not in seen:
                found |= fields_of(registry.views.get(tree.value, ""), registry, seen | {tree.value.lower()})
        else:
            found.add(name)
    return found


def search(items: DataFrame, text: str, registry: FieldRegistry | None = None, as_of: date | None = None) -> DataFrame:
    """The rows of items that an expression finds."""
    return items.where(Compiler(items, registry, as_of).predicate(text))
