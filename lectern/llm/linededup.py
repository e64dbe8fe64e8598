"""Near-duplicate lines by deletion neighbourhoods, in words.

Two lines are near when one edit of one word (a change, an insertion, a deletion) makes the one the other. The variants of a
line within that bound are the line itself and the line without its i-th word. Lines of one length are near if they agree once
both lack their i-th word; a line is near one that is a word shorter if it becomes it by lacking a word. So the hashed variants
are joined, each line learns of the earliest other one that shares a variant, and the two lines' words are compared to verify.

Before that, lines that cannot be near any other are set aside, without loss: an edit leaves the first or the last half of the
shorter line as it is, so a line both of whose halves are unlike those of all lines of fitting length needs no variants.

Everything is built-in DataFrame functions. Exact copies of a line are one row by then, and groups of any size are reduced to
their earliest member by partial aggregates, never to pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, free_name, small_side, tidy

#: Lines of fewer words are compared exactly only.
MIN_WORDS = 8
_SPACE = r"[ \t\x0B\f\r]+"


def _position(doc: str, line: str) -> Column:
    """One number that orders lines by document and place; exact for any document id."""
    return (F.col(doc).cast("decimal(19,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col(line)).cast("decimal(30,0)")


def _place(position: str, doc: str = "d", line: str = "a") -> tuple[Column, Column]:
    """The document and the place in it that a position stands for."""
    unit = F.lit(2**31).cast("decimal(10,0)")
    at = F.pmod(F.col(position), unit)
    return ((F.col(position) - at) / unit).cast("decimal(19,0)").alias(doc), at.cast("int").alias(line)


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, at, line): a row for each \\n-split line that has a word, of documents with an id; its words with one blank between."""
    split = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("at", "line"))
    line = F.col("line")
    odd = line.startswith(" ") | line.endswith(" ") | line.contains("  ") | line.contains("\t") | line.contains("\r") | line.contains("\x0b") | line.contains("\f")
    return split.withColumn("line", F.when(odd, F.trim(F.regexp_replace(line, _SPACE, " "))).otherwise(line)).where("line <> ''")


def _hashed(rows: DataFrame) -> DataFrame:
    """With the two hashes that stand for a line."""
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("line"), "line")})


def _half_keys(least: Column) -> dict[str, Column]:
    """Hashes of the first and the last half (p and s), of the line as the shorter or equal one of a pair (0), and as the longer
    one (1); null for lines of fewer words than least."""
    words = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    made = {"n": words}
    for longer in (0, 1):
        shorter = F.col("n") - longer
        made[f"p{longer}"] = F.when(F.col("n") >= least, F.xxhash64(F.lit("first"), shorter, F.expr(f"substring_index(line, ' ', (n - {longer}) div 2)")))
        made[f"s{longer}"] = F.when(F.col("n") >= least, F.xxhash64(F.lit("last"), shorter, F.expr(f"substring_index(line, ' ', -((n - {longer}) div 2))")))
    return made


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether one edit of one word, or none, makes the word list a the word list b."""
    long, short = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d))
    # Of a list one longer: its first word that is not the other's goes.
    at = F.array_position(F.zip_with(long, short, lambda x, y: F.coalesce(x != y, F.lit(True))), True).cast("int")
    lacks = F.concat(F.slice(long, F.lit(1), at - 1), F.slice(long, at + 1, F.size(long)))
    return F.when(F.size(a) == F.size(b), differ <= 1).when(F.abs(F.size(a) - F.size(b)) == 1, lacks == short).otherwise(False)


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, at, near): the lines that go. near: false if an earlier line has the same words, else true, if one is near."""
    halves = _half_keys(F.lit(min_words))
    found = _hashed(lines(docs, id_col, text_col)).withColumns({"pos": _position("doc", "at"), "n": halves.pop("n")}).withColumns(halves)
    occurrences = cut(found.select("doc", "at", "pos", "h1", "h2", *halves))
    distinct = cut(occurrences.groupBy("h1", "h2").agg(F.min("pos").alias("first"), F.count("*").alias("n"), *(F.min(c).alias(c) for c in halves)))

    # Two longs a row: a hash of the line will do to find suspects, as a clash only adds some.
    keys = distinct.where("p0 is not null").select("h1", F.explode(F.array(*(F.struct(F.lit(c[0] == "p").alias("front"), F.col(c).alias("key")) for c in halves))).alias("e")).select("h1", "e.front", "e.key")
    shared = keys.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select(F.col("key").alias("k"))
    marked = keys.join(shared, F.col("key") == F.col("k"), "left_semi").groupBy(F.col("h1").alias("m1")).agg(F.max("front").alias("front"), F.min("front").alias("all_front"))
    suspects = distinct.join(marked, F.col("h1") == F.col("m1")).select(F.col("h1").alias("s1"), "h1", "h2", F.col("first").alias("pos"), "front", (~F.col("all_front")).alias("back"), *_place("first"))
    suspects = cut(suspects)
    # A suspect's words are those of its first place. Lines meet suspects by place, of which each is one line, so a line that
    # many documents share is no hot key.
    texts = lines(docs, id_col, text_col).join(small_side(suspects), (F.col("doc") == F.col("d")) & (F.col("at") == F.col("a")))
    texts = cut(texts.where(F.xxhash64("line") == F.col("s1")).select("pos", "h1", "h2", "front", "back", F.split("line", " ").alias("words")).dropDuplicates(["pos"]))

    # The line itself is variant 0; without its i-th word it is variant i. Where only the first halves agree with another line,
    # the edit is behind them; where only the last ones do, it is before them.
    # A variant is known by 96 bits, so that the earliest line that has it is one that is near, and not one of a like hash.
    keyed = lambda *parts: (F.xxhash64(*parts).alias("key"), F.hash(*parts).alias("check"))
    n, w = F.size("words"), F.col("codes")
    low, high = F.when(F.col("back"), 1).otherwise(F.floor((n - 1) / 2).cast("int") + 1), F.when(F.col("front"), n).otherwise(F.floor(n / 2).cast("int"))
    lacking = F.transform(F.sequence(low, high), lambda i: F.struct(i.alias("i"), *keyed(F.slice(w, F.lit(1), i - 1), F.slice(w, i + 1, n))))
    coded = texts.withColumn("codes", F.transform("words", lambda x: F.xxhash64(x)))
    variants = cut(coded.select("pos", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("i"), *keyed(w))), lacking)).alias("v")).select("pos", "v.*"))
    earliest = cut(variants.groupBy("key", "check", "i").agg(F.min("pos").alias("least")))
    whole = earliest.where("i = 0").select(F.col("key").alias("wk"), F.col("check").alias("wc"), F.col("least").alias("whole"))
    lacks = earliest.where("i > 0").groupBy(F.col("key").alias("lk"), F.col("check").alias("lc")).agg(F.min("least").alias("lacks"))
    same = earliest.where("i > 0").select(F.col("key").alias("sk"), F.col("check").alias("sc"), F.col("i").alias("si"), "least")
    met = (
        variants.join(same, (F.col("key") == F.col("sk")) & (F.col("check") == F.col("sc")) & (F.col("i") == F.col("si")), "left")
        .join(whole, (F.col("key") == F.col("wk")) & (F.col("check") == F.col("wc")) & (F.col("i") > 0), "left")
        .join(lacks, (F.col("key") == F.col("lk")) & (F.col("check") == F.col("lc")) & (F.col("i") == 0), "left")
        .withColumn("witness", F.explode(F.array("least", "whole", "lacks")))
        .where("witness < pos").select("pos", "witness").distinct()
    )
    other = texts.select(F.col("pos").alias("op"), F.col("words").alias("other"))
    verified = met.join(texts.select(F.col("pos").alias("p"), "h1", "h2", "words"), F.col("pos") == F.col("p")).join(other, F.col("witness") == F.col("op")).where(within_one_edit(F.col("words"), F.col("other")))
    near = verified.select(F.col("h1").alias("n1"), F.col("h2").alias("n2"), F.lit(True).alias("near")).distinct()

    firsts = distinct.join(small_side(cut(near)), (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2")), "left").where("n > 1 or near").select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = occurrences.select("doc", "at", "pos", "h1", "h2").join(small_side(cut(firsts)), (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")))
    return gone.where("near or pos > first").select("doc", "at", (F.col("near") & (F.col("pos") == F.col("first"))).alias("near"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with all its columns, its text without the lines that go, and n_lines (with a word), n_exact and n_near (gone); an
    underscore follows these names where docs has them already.

    A line goes if an earlier one, by document id and place, has the same words, or is one word edit away and both have at
    least min_words words (n_near counts the first of its kind, n_exact the copies). White space between words does not count;
    the lines that stay are unchanged, and lines without a word stay. Null texts stay null; documents with a null id stay
    whole and make no other line go; ids are whole numbers. Rows that repeat an id are one document: their lines tie, and ties
    stay. A text of any length is read in whole. A document may lose all its lines; its text is then empty. An empty table
    gives an empty result."""
    names = [free_name(c, *docs.columns) for c in ("doc_of", "gone_at", "exact_of", "near_of", "n_lines", "n_exact", "n_near")]
    doc, at, exact, near = (F.col(c) for c in names[:4])
    with tidy() as keep:
        gone = duplicates(docs, id_col, text_col, min_words).distinct()
        by_doc = gone.groupBy(F.col("doc").alias(names[0])).agg(F.array_sort(F.collect_set("at")).alias(names[1]), F.count_if(~F.col("near")).alias(names[2]), F.count_if("near").alias(names[3]))
        by_doc = keep(cut(by_doc))
    # A byte for each line up to the last that goes, 1 for those that go: a look at a line's own byte costs the same in a text
    # of any number of lines.
    gap = lambda x, i: x - F.coalesce(F.get(at, i - 1) + 1, F.lit(0))
    flags = F.array_join(F.transform(at, lambda x, i: F.concat(F.repeat(F.lit("0"), gap(x, i)), F.lit("1"))), "").cast("binary")
    flagged = small_side(by_doc, lists=names[1]).withColumn(names[1], flags)
    split = F.split(F.col(text_col), "\n")
    left = F.filter(F.transform(split, lambda x, i: F.when(at.substr(i + 1, F.lit(1)) != F.lit(b"1"), x)), lambda x: x.isNotNull())
    has_word = F.filter(split, lambda x: x.rlike(r"[^ \t\x0B\f\r]"))
    out = docs.join(flagged, F.col(id_col) == doc, "left")
    counts = (F.when(F.col(text_col).isNull(), 0).otherwise(F.size(has_word)), F.coalesce(exact, F.lit(0)), F.coalesce(near, F.lit(0)))
    return out.select(*(F.when(doc.isNull(), F.col(c)).otherwise(F.array_join(left, "\n")).alias(c) if c == text_col else F.col(c) for c in docs.columns), *(v.cast("long").alias(k) for k, v in zip(names[4:], counts)))


#: doc_id, n_lines, n_exact, n_near and the md5 of the text that stays, over documents, in DuckDB's SQL: all variants, as text.
SQL = r"""
WITH l AS (
  SELECT doc_id, ln, line, trim(regexp_replace(line, '[ \t\v\f\r]+', ' ', 'g'), ' ') AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents WHERE doc_id IS NOT NULL)
), own AS (SELECT * FROM l WHERE words <> ''
), firsts AS (SELECT words, min((doc_id, ln)) AS pos FROM own GROUP BY words
), listed AS (SELECT words, pos, string_split(words, ' ') AS w FROM firsts WHERE len(string_split(words, ' ')) >= 8
), variants AS (
  SELECT words, pos, 0 AS i, words AS v FROM listed
  UNION ALL SELECT words, pos, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') FROM (SELECT words, pos, w, unnest(range(1, len(w) + 1)) AS i FROM listed)
), lacks AS (SELECT v, min(pos) AS m FROM variants WHERE i > 0 GROUP BY v
), same AS (SELECT v, i, min(pos) AS m FROM variants WHERE i > 0 GROUP BY v, i
), near AS (
  SELECT DISTINCT words FROM (
    SELECT a.words FROM variants a JOIN same b ON a.i = b.i AND a.v = b.v WHERE b.m < a.pos
    UNION ALL SELECT a.words FROM variants a JOIN variants b ON b.i = 0 AND a.i > 0 AND a.v = b.v WHERE b.pos < a.pos
    UNION ALL SELECT a.words FROM variants a JOIN lacks b ON a.i = 0 AND a.v = b.v WHERE b.m < a.pos)
), judged AS (
  SELECT own.doc_id, own.ln, (own.doc_id, own.ln) > pos AS exact, near.words IS NOT NULL AS near FROM own JOIN firsts USING (words) LEFT JOIN near USING (words)
), said AS (
  SELECT l.doc_id, l.ln, l.line, l.words <> '' AS has_word, coalesce(exact, false) AS exact, coalesce(near, false) AS near FROM l LEFT JOIN judged USING (doc_id, ln)
), summed AS (
  SELECT doc_id, count_if(has_word) AS n_lines, count_if(exact) AS n_exact, count_if(near AND NOT exact) AS n_near,
    md5(coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE NOT exact AND NOT near), '')) AS text_md5 FROM said GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_exact, 0)::BIGINT AS n_exact, coalesce(n_near, 0)::BIGINT AS n_near,
  CASE WHEN text IS NULL THEN NULL ELSE coalesce(text_md5, md5(text)) END AS text_md5
FROM documents d LEFT JOIN summed USING (doc_id)
"""
