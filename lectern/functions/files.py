"""What the bytes of book files and covers tell. Sizes of PNG images, and checks of PDF and Kindle files, are built-in
expressions over `content`; zip archives and JPEG segments are walked in Arrow batches."""

from __future__ import annotations

import io
import posixpath
import struct
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Signatures of PDF locks and their makers; ways to scramble fonts; what font files are called.
PDF_LOCKS = (("EBX_HANDLER", "Adobe ADEPT"), ("FOPN_foweb", "FileOpen"), ("FOPN_fLock", "FileOpen"), ("ns.adobe.com/adept", "Adobe ADEPT"))
FONT_SCRAMBLERS = ("http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#rc")
FONT_FILES = (".ttf", ".otf", ".woff", ".woff2", ".dfont", ".ttc")
THIN_TEXT = 30_000


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of all files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def stored(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """(path): each file below a folder whose name has that ending, by its path there; of a folder with that ending, such as a
    table in several parts, the folder in their place."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/") + "/"
    own = F.when(F.startswith("path", F.lit(root)), F.substring("path", len(root) + 1, 1 << 30)).otherwise(F.col("path"))
    outer = F.regexp_extract(own, rf"^((?:[^/]+/)*?[^/]+\Q{ending}\E)(?:/|$)", 1)
    return read_files(spark, path, f"*{ending}").select(outer.alias("path")).distinct()


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def _number(content: Column, at: int, size: int) -> Column:
    """A big-endian number out of bytes; at counts from 0."""
    return F.conv(F.hex(F.substring(content, at + 1, size)), 16, 10).cast("long")


def png_size(content: Column) -> Column:
    """struct(width, height), or null."""
    is_png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    return F.when(is_png & (F.length(content) >= 24), F.struct(_number(content, 16, 4).cast("int").alias("width"), _number(content, 20, 4).cast("int").alias("height")))


def jpeg_dimensions(data: bytes | None) -> tuple[int, int] | None:
    """Width and height out of the frame header: segments are passed over by their lengths up to the first one."""
    if not data or data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:  # stray bytes: on to the next marker
            at = data.find(b"\xff", at)
            if at < 0 or at + 4 > len(data):
                return None
        marker = data[at + 1]
        if marker == 0xFF or marker == 0x01 or 0xD0 <= marker <= 0xD8:  # fill bytes, and markers without a length
            at += 1 if marker == 0xFF else 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return (lambda hw: (hw[1], hw[0]))(struct.unpack_from(">HH", data, at + 5)) if at + 9 <= len(data) else None
        else:
            at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    return None


def image_size(content: Column) -> Column:
    """struct(width, height) of a PNG or JPEG by its bytes, or null."""

    @F.pandas_udf("width int, height int")
    def jpeg(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([jpeg_dimensions(x) or (None, None) for x in s], columns=["width", "height"]).astype("Int32")

    size = jpeg(F.when(F.hex(F.substring(content, 1, 2)) == "FFD8", content))
    return F.coalesce(png_size(content), F.when(size["width"].isNotNull(), size))



def pdf_flags(content: Column) -> Column:
    """PDF_BAD_HEADER, PDF_NO_EOF (no end mark in the last 2048 bytes)."""
    tail = F.when(F.length(content) > 2048, F.substring(content, -2048, 2048)).otherwise(content)
    flags = F.array(F.when(F.hex(F.substring(content, 1, 5)) != "255044462D", F.lit("PDF_BAD_HEADER")), F.when(~tail.contains(F.lit("%%EOF").cast("binary")), F.lit("PDF_NO_EOF")))
    return F.array_compact(flags)


def pdf_lock(content: Column) -> Column:
    """struct(status, kind) of a PDF: DRM by a maker's signature, BENIGN if its end names an encryption that is not known, or
    CLEAN."""
    found = F.lit(None).cast("string")
    for text, maker in PDF_LOCKS[::-1]:
        found = F.when(content.contains(F.lit(text).cast("binary")), maker).otherwise(found)
    tail = F.when(F.length(content) > 65536, F.substring(content, -65536, 65536)).otherwise(content)
    other = tail.contains(F.lit("/Encrypt").cast("binary"))
    return F.struct(F.when(found.isNotNull(), "DRM").when(other, "BENIGN").otherwise("CLEAN").alias("status"), F.coalesce(found, F.when(other, "encrypted-unclassified"), F.lit("")).alias("kind"))


def mobi_lock(content: Column) -> Column:
    """struct(status, kind) of a Kindle file: the encryption type in record 0."""
    start = _number(content, 78, 4)
    kind = F.conv(F.hex(F.substring(content, (start + 13).cast("int"), F.lit(2))), 16, 10).cast("int")
    broken = (F.length(content) < 82) | (_number(content, 76, 2) < 1) | (F.length(content) < start + 14)
    return F.struct(F.when(broken, "ERROR").when(kind == 0, "CLEAN").otherwise("DRM").alias("status"), F.when(broken, "unreadable").when(kind == 0, "").otherwise("Mobipocket").alias("kind"))


def _named(root: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in root.iter() if e.tag.rpartition("}")[2] == name]


def epub_lock_of(data: bytes | None) -> tuple[str, str]:
    """Status and kind of an EPUB: DRM if other things than fonts are encrypted."""
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            names = z.namelist()
            mark = "Adobe ADEPT" if "META-INF/rights.xml" in names else "Apple FairPlay" if any(n.lower().endswith("sinf.xml") for n in names) else ""
            listed = locked = None
            if "META-INF/encryption.xml" in names:
                try:
                    entries = _named(ElementTree.fromstring(z.read("META-INF/encryption.xml")), "EncryptedData")
                except ElementTree.ParseError:
                    return "DRM", mark or "encrypted content"
                listed, locked = len(entries), 0
                for e in entries:
                    way = "".join((m.get("Algorithm") or "").strip().lower() for m in _named(e, "EncryptionMethod")[:1])
                    target = "".join((m.get("URI") or "").strip().lower() for m in _named(e, "CipherReference")[:1])
                    locked += not (way in FONT_SCRAMBLERS or target.endswith(FONT_FILES) or "/fonts/" in f"/{target}")
            if locked:
                return "DRM", mark or "encrypted content"
            if mark:
                return "BENIGN", "residual DRM marker"
            return ("CLEAN", "") if listed is None else ("BENIGN", "font obfuscation" if listed else "empty")
    except Exception:  # a file of any shape may come; it is told as unreadable
        return "ERROR", "unreadable"


def epub_flags_of(data: bytes | None) -> list[str]:
    """What is wrong with an EPUB: archive, container, package, spine, and how much text it has."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data or b""))
    except zipfile.BadZipFile:
        return ["EPUB_BADZIP:BadZipFile"]
    with z:
        try:
            broken = z.testzip()
        except Exception as e:  # a damaged stream, a method or a password that can't be read
            broken = type(e).__name__
        flags, names = ([f"EPUB_CRC:{broken}"] if broken else []), set(z.namelist())
        if "META-INF/container.xml" not in names:
            return [*flags, "EPUB_NO_CONTAINER"]
        try:
            roots = _named(ElementTree.fromstring(z.read("META-INF/container.xml")), "rootfile")
            package = roots[0].get("full-path") if roots else None
            if not package:
                return [*flags, "EPUB_OPF_UNREADABLE:NoRootfile"]
            opf = ElementTree.fromstring(z.read(package))
        except Exception as e:
            return [*flags, f"EPUB_OPF_UNREADABLE:{type(e).__name__}"]
        folder = posixpath.dirname(package)
        files = {e.get("id"): posixpath.normpath(posixpath.join(folder, unquote(e.get("href", "").partition("#")[0]))) for e in _named(opf, "item")}
        spine = [files.get(e.get("idref")) for e in _named(opf, "itemref")]
        there = [f for f in spine if f in names]
        size = sum(z.getinfo(f).file_size for f in there)
        return flags + ["EPUB_EMPTY_SPINE"] * (not spine) + [f"EPUB_SPINE_MISSING:{len(spine) - len(there)}/{len(spine)}"] * (len(there) < len(spine)) + [f"EPUB_THIN_TEXT:{size}B"] * bool(spine and size < THIN_TEXT)


def epub_text_of(data: bytes | None, head: int = 8, tail: int = 3, most: int = 4 << 20) -> str | None:
    """The text of an EPUB's first and last pages by name, without tags; null if it can't be read."""
    import re

    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            pages = sorted(n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm")))
            some, out, size = dict.fromkeys(pages[:head] + pages[-tail:]), [], 0
            for n in some:
                raw = z.read(n)[: most - size]
                size += len(raw)
                out.append(re.sub(r"<[^>]+>", " ", raw.decode("utf-8", "replace")))
            return " ".join(out)
    except Exception:
        return None


def epub_lock(content: Column) -> Column:
    @F.pandas_udf("status string, kind string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([epub_lock_of(x) for x in s], columns=["status", "kind"])

    return run(content)


def epub_flags(content: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(epub_flags_of)

    return run(content)


def epub_text(content: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(epub_text_of)

    return run(content)


def locks(files: DataFrame) -> DataFrame:
    """(path, status, kind) of book files (path, content): CLEAN, BENIGN, DRM or ERROR; N/A for kinds that have no locks."""
    ext, content = extension(F.col("path")), F.col("content")
    epub = epub_lock(F.when(ext == "epub", content))
    verdict = F.when(ext == "epub", epub).when(ext == "pdf", pdf_lock(content)).when(ext.isin("azw3", "mobi", "azw", "prc"), mobi_lock(content)).otherwise(F.struct(F.lit("N/A").alias("status"), F.lit("").alias("kind")))
    return files.select("path", verdict.alias("v")).select("path", "v.status", "v.kind")


def read_with(files: DataFrame, readers: dict[str, Callable[[bytes], dict | None]], schema: str, columns: tuple[str, ...] = ("path",)) -> DataFrame:
    """files (path, content) with what a reader of their extension makes of their bytes, as columns of schema: text and metadata
    of formats whose tools are not at hand, numbers of pages, ways of encryption. A reader gives a dictionary, or None; it need
    not mind errors. `readable` tells null where no reader is known, else whether the reader gave something. A file at a time is
    held."""
    names = [f.name for f in StructType.fromDDL(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                reader = readers.get(row["path"].rpartition(".")[2].lower())
                try:
                    got = reader(row["content"]) if reader and row["content"] is not None else None
                except Exception:  # a file of any shape may come; it is told as unreadable
                    got = None
                rows.append([row[c] for c in columns] + [bool(got) if reader else None] + [(got or {}).get(n) for n in names])
            yield pd.DataFrame(rows, columns=[*columns, "readable", *names], dtype=object)

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*columns).schema)
    return files.select(*dict.fromkeys((*columns, "path", "content"))).mapInPandas(run, f"{own}, readable boolean, {schema}")


def first_readable(read: DataFrame, key: str = "id") -> DataFrame:
    """(key, state, path, text) out of read_with(): the first file by path that gives a text. state: READ; UNREADABLE, where
    files of known formats gave nothing; SKIPPED, where no format is known."""
    has = F.coalesce(F.col("text") != "", F.lit(False))
    best = F.min(F.when(has, F.struct("path", "text"))).alias("best")
    found = read.groupBy(key).agg(best, F.count("readable").alias("known"))
    state = F.when(F.col("best").isNotNull(), "READ").when(F.col("known") > 0, "UNREADABLE").otherwise("SKIPPED")
    return found.select(key, state.alias("state"), "best.path", "best.text")


def missing_files(listed: DataFrame, files: DataFrame) -> DataFrame:
    """(path, flags): listed files that are not there."""
    return listed.join(files.select(F.col("path").alias("__path")), F.col("path") == F.col("__path"), "left_anti").select("path", F.array(F.lit("FILE_MISSING")).alias("flags"))


def file_flags(files: DataFrame) -> DataFrame:
    """(path, flags): what is wrong with EPUB and PDF files."""
    ext, content = extension(F.col("path")), F.col("content")
    flags = F.when(ext == "epub", epub_flags(F.when(ext == "epub", content))).when(ext == "pdf", pdf_flags(content)).otherwise(F.array().cast("array<string>"))
    return files.select("path", flags.alias("flags"))


def compression_advice(features: DataFrame) -> DataFrame:
    """features (size, form, javascript, attachments, optimized, avg_dpi) with `advice` on shrinking a PDF and `estimate`, the
    percent that it may save."""
    size, dpi = F.col("size") / (1 << 20), F.col("avg_dpi")
    risky = ~F.lower(F.coalesce("form", F.lit(""))).isin("", "none") | F.coalesce("javascript", F.lit(False)) | (F.coalesce("attachments", F.lit(0)) > 0)
    advice = (
        F.when(size < 50, "skip-small").when(dpi.isNull(), "manual").when(F.col("optimized") & (size < 200) & (dpi <= 200), "skip-optimized")
        .when(dpi < 150, "skip-already-low-dpi").when(risky | (dpi < 250), "printer").otherwise("ebook")
    )
    return features.withColumns({"advice": advice, "estimate": F.when(dpi >= 150, F.floor(100 * (1 - F.pow(150 / dpi, F.lit(2)))).cast("int"))})
