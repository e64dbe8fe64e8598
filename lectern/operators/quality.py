"""Audits, integrity rules, text lints, drift and review of a catalog. Rules give rows; nothing is printed here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.dates import UNDEFINED, day_of
from lectern.functions.display import primary_author
from lectern.functions.isbn import amazon_is_isbn
from lectern.functions.text import collapse, plain_text, strip, title_case
from lectern.operators.reports import gaps, series_rollup
from lectern.operators.scope import under

#: Formats that nothing reads any more.
DEPRECATED_FORMATS = ("MOBI", "LIT", "LRF", "DJVU", "PDB", "AZW")
#: Identifier types that are never right, and those that are known.
FORBIDDEN_TYPES = (
    "url", "uri", "urn", "guid", "id", "revision", "created", "genre", "author_origin", "notes_images", "maxpg", "grvotes", "grrating",
    "isbn-13", "isbn-10", "isbn13", "isbn10", "eisbn", "ean", "sbn", "urnisbn",
)
KNOWN_TYPES = (
    "isbn", "amazon", "amazon_uk", "amazon_de", "amazon_fr", "amazon_es", "amazon_it", "amazon_ca", "amazon_jp", "amazon_in", "mobi-asin",
    "goodreads", "google", "storygraph", "openlibrary", "isfdb", "isfdb-title", "kobo", "barnesnoble", "fictiondb", "doi", "oclc", "lccn",
    "hardcover", "hardcover-edition", "librarything", "douban", "dnb", "worldcat", "issn",
)
# Bytes of UTF-8 that were read as Latin-1 or its Windows cousin: letters up to U+017F have two, dashes and quotes three.
_LATER = "[" + "".join(chr(b) for b in range(0x80, 0xC0)) + "".join(c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))) + "]"
MOJIBAKE = "\ufffd|[\u00c2-\u00c5]" + _LATER + "|[\u00e0-\u00ef]" + _LATER * 2
#: Words of a name that is a firm's and no person's.
FIRM_WORDS = ("press", "publisher", "publishers", "publishing", "publications", "publication", "verlag", "books", "editions", "edition", "editor", "editors", "library", "classics", "company", "inc", "ltd", "llc", "gmbh")
#: Words with odd capitals that are right.
CASE_OK = ("SQLite", "QBasic", "OAuth", "JScript", "DRMed", "POSIXly", "OCaml", "NCurses")
MIN_COMMENT = 120
#: Findings that make a file unusable.
HARD_FLAGS = ("EPUB_BADZIP", "EPUB_CRC", "EPUB_NO_CONTAINER", "EPUB_OPF_UNREADABLE", "EPUB_EMPTY_SPINE", "EPUB_SPINE_MISSING", "FILE_MISSING", "PDF_BAD_HEADER")
#: The fields that each format can hold.
DRIFT_FIELDS = {
    "EPUB": ("title", "authors", "series", "publisher", "pubdate", "languages", "tags", "identifiers", "comments"),
    "AZW3": ("title", "authors", "series", "publisher", "pubdate", "languages", "tags", "identifiers", "comments"),
    "MOBI": ("title", "authors", "publisher", "pubdate", "languages", "tags", "comments"),
    "PDF": ("title", "authors", "publisher"),
    "DJVU": ("title", "authors"),
}


def _list(*conditions: tuple[Column, str | Column]) -> Column:
    """The names whose condition holds."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n) if isinstance(n, str) else n) for c, n in conditions)))


# Audit


def item_issues(items: DataFrame, covers: DataFrame | None = None) -> DataFrame:
    """(id, title, author, issues array): items with an issue. covers: (id, width, height) of the cover files that exist; null
    sizes are of files that can't be read. Without it, cover files are not looked at."""
    upper = F.transform("formats", lambda x: F.upper(F.trim(x)))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    old = (n("formats") > 0) & (F.size(F.array_except(upper, F.array(*map(F.lit, DEPRECATED_FORMATS)))) == 0)
    has_cover = F.coalesce("cover", F.lit(False))
    rules = [
        (n("tags") == 0, "no_tags"), (F.col("rating").isNull(), "unrated"), ((n("authors") == 0) | (F.array_join("authors", ",") == "Unknown"), "no_author"),
        (n("formats") == 0, "no_file"), (old, "deprecated_format_only"), (~has_cover, "no_cover"),
    ]
    rows = items
    if covers is not None:
        rows = items.join(covers.select(F.col("id").alias("__id"), F.col("width").alias("__w"), F.col("height").alias("__h")), F.col("id") == F.col("__id"), "left")
        small = F.greatest("__w", "__h") < 500
        rules += [(has_cover & F.col("__id").isNull(), "cover_file_missing"), (has_cover & small, F.concat(F.lit("low_res_cover("), F.col("__w"), F.lit("x"), F.col("__h"), F.lit(")")))]
    return rows.select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("author_sort", F.lit("")).alias("author"), _list(*rules).alias("issues")).where(F.size("issues") > 0)


def _twin_keys(items: DataFrame) -> DataFrame:
    named = items.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce(F.size("authors"), F.lit(0)) > 0))
    return named.select("id", F.lower(strip(F.col("title"))).alias("title_key"), F.lower(strip(primary_author(F.col("authors")))).alias("author_key"))


def duplicate_members(items: DataFrame) -> DataFrame:
    """(id, first, n): each item of a group of duplicate_items(), with the group's smallest id and size. Groups of any size:
    counts are gathered before they are shuffled, and no task lists a group."""
    keys = _twin_keys(items)
    groups = keys.groupBy("title_key", "author_key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return keys.join(groups, ["title_key", "author_key"]).select("id", "first", "n")


def duplicate_items(items: DataFrame) -> DataFrame:
    """(title_key, author_key, ids array, n): items that agree in title and primary author but for case and outer blanks. Items
    without a title or an author agree with none. The ids of a group are one value; duplicate_members() has them in rows."""
    return _twin_keys(items).groupBy("title_key", "author_key").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count("*").alias("n")).where("n > 1")


def audit(items: DataFrame, covers: DataFrame | None = None) -> DataFrame:
    """(section, id, title, author, issue_type, issues): issues of items, duplicates and gaps in series, of one shape."""
    own = item_issues(items, covers).select(F.lit("book").alias("section"), F.col("id").cast("string").alias("id"), "title", "author", F.lit("book").alias("issue_type"), F.array_join("issues", ", ").alias("issues"))
    twice = duplicate_items(items).select(F.lit("duplicate"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ", "), title_case(F.col("title_key")), title_case(F.col("author_key")), F.lit("duplicate"), F.lit("duplicate_books"))
    missing = gaps(F.col("indices"), F.col("last"))
    series = series_rollup(items).select(F.lit("series_gap"), F.lit(""), "series", F.lit(""), F.lit("series_gap"), F.concat(F.lit("missing indices: "), F.nullif(F.array_join(missing.cast("array<string>"), ", "), F.lit(""))).alias("g")).where("g is not null")
    return own.union(twice).union(series)


def issue_counts(issues: DataFrame) -> DataFrame:
    """(issue, n) out of item_issues(); what stands in parentheses does not count."""
    return issues.select(F.explode("issues").alias("i")).groupBy(F.substring_index("i", "(", 1).alias("issue")).agg(F.count("*").alias("n"))


# Integrity rules: (code, severity, id, message)


def finding(rows: DataFrame, code: str, severity: str, id_col: Column, message: Column) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), id_col.cast("string").alias("id"), message.alias("message"))


def without(rows: DataFrame, links: DataFrame, key: str, link_key: str) -> DataFrame:
    """Rows that nothing links to."""
    return rows.join(links.select(F.col(link_key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")


def duplicate_values(rows: DataFrame, value: str, owner: str) -> DataFrame:
    """(value, owners): values that several owners share."""
    return rows.groupBy(value).agg(F.countDistinct(owner).alias("owners")).where("owners > 1")


def date_findings(books: DataFrame, column: str = "pubdate") -> DataFrame:
    raw = F.col(column)
    bad = books.where(raw.isNotNull() & day_of(raw).isNull() & ~raw.rlike("^(" + "|".join(UNDEFINED) + ")"))
    unknown = books.where(raw.startswith(UNDEFINED[0]))
    return finding(bad, "PUBDATE_PARSEABLE", "E", F.col("id"), raw).union(finding(unknown, "NO_SENTINEL_PUBDATE", "W", F.col("id"), raw))


def identifier_type_findings(identifiers: DataFrame, column: str = "type", strict: bool = False, forbidden=FORBIDDEN_TYPES, known=KNOWN_TYPES) -> DataFrame:
    """(type, n, code, severity): identifier types that are forbidden (E), and with strict those that nobody declared (W)."""
    counts = identifiers.groupBy(F.col(column).alias("type")).agg(F.count("*").alias("n"))
    code = F.when(F.lower("type").isin(*forbidden), "ID_TYPE_FORBIDDEN").when(F.lit(strict) & ~F.lower("type").isin(*known), "ID_TYPE_UNDECLARED")
    return counts.withColumns({"code": code, "severity": F.when(F.endswith(code, F.lit("FORBIDDEN")), "E").otherwise("W")}).where("code is not null")


def amazon_findings(identifiers: DataFrame) -> DataFrame:
    rows = identifiers.where(F.col("type").startswith("amazon") & amazon_is_isbn(F.col("val")))
    return finding(rows, "AMAZON_IS_ISBN10", "W", F.col("book"), F.col("val"))


def not_in_spec(values: DataFrame, spec: DataFrame, column: str, spec_column: str) -> DataFrame:
    """Distinct values that a specification does not list."""
    return without(values.select(column).distinct(), spec, column, spec_column)


def flatten_taxonomy(nodes: list, above: str = "") -> list[str]:
    """The valid tags of a taxonomy tree: leaves, and branches that may stand bare."""
    found = []
    for node in nodes:
        name, below, bare = (node, [], True) if isinstance(node, str) else (node["name"], node.get("children", []), node.get("bare_allowed", not node.get("children")))
        path = f"{above}.{name}" if above else name
        found += [path] * bool(bare) + flatten_taxonomy(below, path)
    return found


def exclusive_format(tagged: DataFrame, key: str, has: Column, lacks: Column, label: Column) -> DataFrame:
    """(key, labels): one row for each key with a row where `has` holds and none where `lacks` does; labels in order."""
    found = tagged.groupBy(key).agg(F.count_if(has).alias("a"), F.count_if(lacks).alias("b"), F.array_join(F.array_sort(F.collect_set(label)), ", ").alias("labels"))
    return found.where("a > 0 and b = 0").select(key, "labels")


def linked(rows: DataFrame, links: DataFrame, key: str, link_key: str) -> DataFrame:
    """Rows that something links to."""
    return rows.join(links.select(F.col(link_key).alias("__k")), F.col(key) == F.col("__k"), "left_semi")


def publisher_findings(publishers: DataFrame, canonicals: dict[str, list[str]], column: str = "name") -> DataFrame:
    """Findings for publishers that stand under another name of theirs. canonicals: the names that each right one goes by."""
    right = {alias: name for name, aliases in canonicals.items() for alias in aliases}
    if not right:
        return finding(publishers.limit(0), "PUBLISHER_NOT_CONSOLIDATED", "W", F.col(column), F.col(column))
    to = F.try_element_at(F.create_map(*(F.lit(x) for pair in sorted(right.items()) for x in pair)), F.col(column))
    found = publishers.select(column).where(F.col(column).isin(*right)).distinct()
    return finding(found, "PUBLISHER_NOT_CONSOLIDATED", "W", F.col(column), F.concat(F.lit("goes by "), to))


def pdf_only_findings(items: DataFrame, branches: tuple[str, ...], wanted: bool = True) -> DataFrame:
    """One finding for each item in the branches that has a PDF and no EPUB, with its tags there; none unless EPUB is wanted."""
    inside = F.filter(F.col("tags"), lambda t: under(t, branches))
    pdf_only = F.array_contains("formats", "PDF") & ~F.array_contains("formats", "EPUB") & (F.size(inside) > 0)
    return finding(items.where(pdf_only & F.lit(bool(wanted and branches))), "FORMAT_FICTION_PDF", "W", F.col("id"), F.array_join(inside, ", "))


def exit_code(findings: DataFrame) -> int:
    """1 if some finding is an error."""
    return int(not findings.where("severity = 'E'").isEmpty())


def shown(findings: DataFrame, most: int = 5) -> DataFrame:
    """findings with `rank` and `total` of each code, the first ones of each code only: what a short report prints."""
    own = Window.partitionBy("severity", "code")
    total = findings.groupBy("severity", "code").agg(F.count("*").alias("total"))
    ranked = findings.withColumn("rank", F.row_number().over(own.orderBy(F.col("id").try_cast("long"), "id", "message"))).where(F.col("rank") <= most)
    return by_severity(ranked.join(total, ["severity", "code"]))


def by_severity(findings: DataFrame) -> DataFrame:
    """Errors first, then by code and id."""
    return findings.orderBy(F.array_position(F.array(F.lit("E"), F.lit("W")), F.col("severity")), "code", "id")


# Text lints


def title_flags(title: Column) -> Column:
    # Capitals that run on into small letters, or stand in their midst.
    odd = lambda w: w.rlike(r"^\p{Lu}{2,}\p{Ll}{2}") | w.rlike(r"\p{Ll}\p{Lu}{2,}\p{Ll}")
    first = F.get(F.filter(F.regexp_extract_all(title, F.lit(r"\p{L}+"), 0), lambda w: odd(w) & ~w.isin(*CASE_OK)), F.lit(0))
    return _list(((title != strip(title)) | title.contains("  "), "TITLE_WHITESPACE"), (title.rlike(MOJIBAKE), "TITLE_MOJIBAKE"), (first.isNotNull(), F.concat(F.lit("TITLE_CASE_GARBLE:"), first)))


def author_flags(authors: Column) -> Column:
    firm = lambda a: F.arrays_overlap(F.split(F.lower(a), r"[^\p{L}]+"), F.array(*map(F.lit, FIRM_WORDS)))
    each = F.flatten(F.transform(authors, lambda a: _list((firm(a), F.concat(F.lit("AUTHOR_JUNK:"), a)), (a.rlike(MOJIBAKE), F.concat(F.lit("AUTHOR_MOJIBAKE:"), a)))))
    return F.concat(each, _list((F.size(authors) > 4, F.concat(F.lit("AUTHOR_CROWD:"), F.size(authors))), (F.size(authors) == 0, "AUTHOR_MISSING")))


def comment_flags(comment: Column) -> Column:
    """Flags of a description, as plain text."""
    text = F.coalesce(plain_text(comment), F.lit(""))
    n = F.length(text)
    return F.when(n == 0, F.array(F.lit("COMMENT_MISSING"))).otherwise(_list((n < MIN_COMMENT, F.concat(F.lit("COMMENT_STUB:"), n)), (text.rlike(MOJIBAKE), "COMMENT_MOJIBAKE")))


def truncated(texts: DataFrame, text_col: str, words: DataFrame, word_col: str) -> DataFrame:
    """Texts of some length that end in the midst of a word: no closing mark, and a last word that the list does not hold."""
    last = F.lower(F.regexp_extract(text_col, r"([\p{L}'’]+)$", 1))
    rows = texts.where((F.length(text_col) >= MIN_COMMENT) & (last != "")).withColumn("__last", F.regexp_replace(last, "['’]+$", ""))
    return rows.join(words.select(F.lower(word_col).alias("__w")).distinct(), F.col("__last") == F.col("__w"), "left_anti").drop("__last")


def hard(flags: Column) -> Column:
    """Whether some flag makes the file unusable."""
    return F.exists(flags, lambda f: F.substring_index(f, ":", 1).isin(*HARD_FLAGS))


# Drift between the catalog and what the files hold


def _norm(c: Column) -> Column:
    return F.lower(collapse(F.coalesce(c, F.lit(""))))


def _set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, _norm), lambda x: x != "")))


def _day(c: Column) -> Column:
    found = F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), r"^\d{4}-\d{2}-\d{2}", 0)
    return F.when(found == UNDEFINED[0], "").otherwise(found)


def parse_identifiers(text: Column) -> Column:
    """type:value pairs, split at commas only, as a map in lower case; blanks are dropped and the last of a type wins."""
    pairs = F.transform(F.split(_norm(text), ","), lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("k"), F.when(p.contains(":"), F.trim(F.regexp_extract(p, r"^[^:]*:(.*)$", 1))).alias("v")))
    full = F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != ""))
    keys = F.array_distinct(F.transform(full, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(full, lambda p: p["k"] == k), -1)["v"]))


def drift(rows: DataFrame, fmt: str, stored: str = "db", embedded: str = "file") -> DataFrame:
    """rows with `drift`: the names of the fields in which a struct of stored metadata (title, authors, series, series_index
    string, publisher, pubdate, languages, tags, identifiers map, comments) and a map of embedded metadata (title, author(s),
    series, publisher, published, languages, tags, identifiers, comments) differ, as far as the format holds them."""
    db, held = (lambda n: F.col(f"{stored}.{n}")), (lambda n: F.coalesce(F.col(embedded)[n], F.lit("")))
    names = F.regexp_replace(F.coalesce(F.nullif(held("author(s)"), F.lit("")), held("author")), r"\s*\[[^\]]*\]", "")
    series = _norm(held("series"))
    series_name, series_index = F.trim(F.regexp_replace(series, r"\s+#\s*[\d.]+$", "")), F.regexp_replace(F.regexp_extract(series, r"\s#\s*([\d.]+)$", 1), r"\.0$", "")
    bare = lambda c: _norm(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " "))
    a, b = bare(db("comments")), bare(held("comments"))
    ids = parse_identifiers(held("identifiers"))
    differ = {
        "title": _norm(db("title")) != _norm(held("title")),
        "authors": _set(db("authors")) != _set(F.split(names, r"\s*[&;]\s*")),
        "series": (_norm(db("series")) != series_name) | (F.coalesce(db("series_index"), F.lit("")) != series_index),
        "publisher": _norm(db("publisher")) != _norm(held("publisher")),
        "pubdate": _day(db("pubdate")) != _day(held("published")),
        "languages": _set(db("languages")) != _set(F.split(held("languages"), r"[,\s]+")),
        "tags": _set(db("tags")) != _set(F.split(held("tags"), r",\s*")),
        "identifiers": F.exists(F.map_entries(F.coalesce(db("identifiers"), F.create_map().cast("map<string,string>"))), lambda e: ~F.coalesce(F.try_element_at(ids, F.lower(e["key"])) == F.lower(F.trim(e["value"])), F.lit(False))),
        "comments": (a != b) & ~((b != "") & a.startswith(b)),  # the readout of a file may cut a long one short
    }
    return rows.withColumn("drift", _list(*((differ[f], f) for f in DRIFT_FIELDS.get(fmt, ()))))


# Review of records


def reconcile_ids(given: DataFrame, emitted: DataFrame, key: str = "id") -> DataFrame:
    """(id, problem): ids that were made up, and ids that are missing; empty if both tables hold the same."""
    invented = given.select(key).distinct().join(emitted, key, "left_anti").select(F.col(key).alias("id"), F.lit("invented").alias("problem"))
    return invented.union(emitted.select(key).distinct().join(given, key, "left_anti").select(key, F.lit("missing")))


def parse_verdicts(lines: DataFrame, column: str = "value") -> DataFrame:
    """(id, title, author, comment, note, error) of lines with tabs or commas; the note keeps what separators it has. Blank
    lines, remarks (#) and the header are passed over; error tells what is wrong with a line, else null."""
    line = F.col(column)
    parts = F.transform(F.when(line.contains("\t"), F.split(line, "\t", 5)).otherwise(F.split(line, ",", 5)), strip)
    rows = lines.where(~strip(line).rlike("^(#|$)")).select(parts.alias("p")).where(F.lower(F.get("p", F.lit(0))) != "id")
    verdicts = F.transform(F.slice("p", 2, 3), F.upper)
    bad = F.filter(verdicts, lambda v: ~v.isin("OK", "BAD"))
    error = F.when(F.size("p") < 4, "too few fields").when(~F.get("p", F.lit(0)).rlike(r"^\d+$"), "no id").when(F.size(bad) > 0, "neither OK nor BAD")
    return rows.select(F.get("p", F.lit(0)).try_cast("long").alias("id"), *(F.get(verdicts, F.lit(i)).alias(n) for i, n in enumerate(("title", "author", "comment"))), F.coalesce(F.get("p", F.lit(4)), F.lit("")).alias("note"), error.alias("error"))


def upsert(ledger: DataFrame, news: DataFrame, key: str = "id") -> DataFrame:
    """The ledger with the rows of news in place of those with the same key."""
    return ledger.join(news, key, "left_anti").unionByName(news)


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """One row: judged records, and those of which something was found bad."""
    bad = F.exists(F.array("title", "author", "comment"), lambda v: F.coalesce(v == "BAD", F.lit(False)))
    return ledger.agg(F.count("*").alias("judged"), F.count_if(bad).alias("bad"))


def worklist(ledger: DataFrame) -> DataFrame:
    """(id, field, note): what was found bad."""
    return ledger.unpivot(["id", "note"], ["title", "author", "comment"], "field", "verdict").where("verdict = 'BAD'").select("id", "field", "note")
