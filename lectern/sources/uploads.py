"""Uploaded files: validation before anything is read from them, and readers."""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES, MAX_PAGES, MAX_ENTRIES, MAX_UNPACKED = 25 << 20, 300, 2000, 100 << 20
# Kinds of files that are accepted.
KINDS = ("pdf", "docx", "txt")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^.\\/]+)$", 1))


def safe_name(name: Column) -> Column:
    """Last part of a path in compatibility composition (NFKC), odd signs as underscores, 200 characters at most."""
    last = F.element_at(F.split(composed(F.coalesce(name, F.lit("")), "NFKC"), r"[\\/]"), -1)
    return F.left(F.trim(F.regexp_replace(last, r"(?U)[^\w.\- ()]+", "_")), F.lit(200))


def reject_code(name: Column, size: Column, pages: Column, most: int = MAX_BYTES) -> Column:
    """The first reason to refuse a file, or ok."""
    return (
        F.when(F.coalesce(size, F.lit(0)) <= 0, "EMPTY_FILE").when(size > most, "FILE_TOO_LARGE")
        .when(~extension(name).isin(*KINDS), "UNSUPPORTED_TYPE").when(pages > MAX_PAGES, "TOO_MANY_PAGES").otherwise("ok")
    )


def composed(text: Column, form: str = "NFC") -> Column:
    """Canonical (NFC) or compatibility (NFKC) composition. Only texts with a sign that it can change go through Python: none below U+0300 for
    NFC, none below U+00A0 for NFKC."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize(form, t) if isinstance(t, str) else None)

    changes = r"[^\x00-\x{2FF}]" if form == "NFC" else r"[^\x00-\x{9F}]"
    return F.when(text.rlike(changes), compose(text)).otherwise(text)


def stored_name(content: Column, name: Column) -> Column:
    """struct(sha256, file): the digest of the content, and a file name made of it and the extension, so that no upload can name a path."""
    digest = F.sha2(content, 256)
    return F.struct(digest.alias("sha256"), F.concat_ws(".", digest, F.nullif(extension(name), F.lit(""))).alias("file"))


def validated(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """binaryFile rows with `code`: empty, size, type and magic number by expressions; pages, archives and encodings are looked at in Python.

    A PDF is encrypted if its trailer says so, corrupt without an end mark, and has as many pages as page objects stand in it in plain (pages in
    compressed object streams aren't seen: then its page tree's count is taken).
    """
    kind = extension(F.col("path"))
    wrong = F.when((kind == "pdf") & (F.substring("content", 1, 5) != F.lit(b"%PDF-")), "BAD_FILE_TYPE").when((kind == "docx") & (F.substring("content", 1, 4) != F.lit(b"PK\x03\x04")), "BAD_FILE_TYPE")

    def pdf(c: bytes) -> str:
        if b"%%EOF" not in c[-2048:]:
            return "CORRUPT_FILE"
        if b"/Encrypt" in c:
            return "ENCRYPTED_PDF"
        counts = [int(x) for x in re.findall(rb"/Type\s*/Pages\b[^>]*?/Count\s+(\d+)|/Count\s+(\d+)[^>]*?/Type\s*/Pages\b", c) for x in x if x]
        pages = len(re.findall(rb"/Type\s*/Page\b(?!s)", c)) or max(counts, default=0)
        return "EMPTY_FILE" if not pages else "TOO_MANY_PAGES" if pages > MAX_PAGES else "ok"

    def docx(c: bytes) -> str:
        try:
            with zipfile.ZipFile(io.BytesIO(c)) as z:
                if not {"[Content_Types].xml", "word/document.xml"} <= set(z.namelist()):
                    return "BAD_FILE_TYPE"
                return "ZIP_BOMB" if len(z.infolist()) > MAX_ENTRIES or sum(i.file_size for i in z.infolist()) > MAX_UNPACKED else "ok"
        except zipfile.BadZipFile:
            return "CORRUPT_FILE"

    def txt(c: bytes) -> str:
        return "BAD_FILE_TYPE" if b"\x00" in c[:8192] else "ok" if decoded(c) else "BAD_ENCODING"

    @F.pandas_udf("string")
    def opened(kinds: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([{"pdf": pdf, "docx": docx, "txt": txt}.get(k, lambda c: "ok")(bytes(c)) for k, c in zip(kinds, contents)])

    first = reject_code(F.col("path"), F.length("content"), F.lit(0), most)
    return files.withColumn("code", F.when(first != "ok", first).otherwise(F.coalesce(wrong, opened(kind, F.col("content")))))


def decoded(content: bytes) -> str:
    """Text of UTF-8, UTF-16 with a mark, or Windows-1252 bytes, line ends as line feeds; '' where none fits."""
    for encoding in (("utf-16",) if content[:2] in (b"\xff\xfe", b"\xfe\xff") else ("utf-8-sig", "cp1252")):
        try:
            return content.decode(encoding).replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            continue
    return ""


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of plain text files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf.path, "text": [decoded(bytes(c)) for c in pdf.content]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, text string")


# Nominal sizes of headings by level, of a title and of body text; a line's height in sizes.
HEADING_SIZES, TITLE_SIZE, BODY_SIZE, LEADING = {1: 16.0, 2: 14.0, 3: 12.0}, 20.0, 11.0, 1.6


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, style, text, size, is_bold, is_italic, y) of the lines of docx files: paragraphs, those of lists with a bullet, then the rows of
    tables with | between their cells. size is the style's, y the sum of the heights of the lines above."""
    from pyspark.sql import Window

    rows = _docx(spark.read.format("binaryFile").load(path))
    above = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("y", F.round(F.coalesce(F.sum(F.col("size") * LEADING).over(above), F.lit(0.0)), 4))


def _docx(files: DataFrame) -> DataFrame:
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def said(node: object) -> str:
        return "".join(t.text or "" for t in node.iter(f"{w}t"))

    def most(par: object, mark: str) -> bool:
        runs = [(len(said(r)), r.find(f"{w}rPr/{w}{mark}")) for r in par.iter(f"{w}r")]
        return 2 * sum(n for n, m in runs if m is not None and m.get(f"{w}val") not in ("0", "false")) > sum(n for n, _ in runs)

    def lines(body: object) -> Iterator[tuple]:
        for par in body.findall(f"{w}p"):
            style = par.find(f"{w}pPr/{w}pStyle")
            name = style.get(f"{w}val") if style is not None else None
            level = int(name[-1]) if name and name[:-1].lower() == "heading" and name[-1].isdigit() else 0
            size = TITLE_SIZE if (name or "").lower() == "title" else HEADING_SIZES.get(level, BODY_SIZE)
            listed = par.find(f"{w}pPr/{w}numPr") is not None or (name or "").lower().startswith("list")
            yield name, ("• " if listed else "") + said(par), size, bool(level) or most(par, "b"), most(par, "i")
        for row in body.iter(f"{w}tr"):
            yield None, " | ".join(said(c) for c in row.findall(f"{w}tc")), BODY_SIZE, False, False

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, c in zip(pdf.path, pdf.content):
                with zipfile.ZipFile(io.BytesIO(bytes(c))) as z:
                    body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
                rows += [(p, n, *line) for n, line in enumerate(lines(body) if body is not None else [])]
            yield pd.DataFrame(rows, columns=["path", "n", "style", "text", "size", "is_bold", "is_italic"])

    return files.select("path", "content").mapInPandas(read, "path string, n long, style string, text string, size double, is_bold boolean, is_italic boolean")


def extracted(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, n, text, code): lines of every file under `path` by its kind: text files line by line, docx by paragraph. A file that is refused, or of
    a kind without a reader here (pdf), has one row with its code and NULL text."""
    glob = lambda kind: spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path)
    every = spark.read.format("binaryFile").load(path)
    codes = validated(every).select("path", extension(F.col("path")).alias("kind"), "code")
    codes = codes.withColumn("code", F.when((F.col("code") == "ok") & (F.col("kind") == "pdf"), "NO_READER").otherwise(F.col("code")))
    good = codes.where("code = 'ok'").select("path")
    txt = texts(spark, path).join(good, "path", "left_semi").where(extension(F.col("path")) == "txt").select("path", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    docx = _docx(glob("docx").join(good, "path", "left_semi")).select("path", F.col("n").cast("int").alias("n"), "text")
    rows = txt.unionByName(docx).withColumn("kind", extension(F.col("path"))).withColumn("code", F.lit("ok"))
    return rows.select("path", "kind", "n", "text", "code").unionByName(codes.where("code <> 'ok'").select("path", "kind", F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("text"), "code"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line with a declared schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
