"""From physical lines to segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

#: Share of a page's height at its top and bottom where running heads are looked for; lines a page of plain text.
BAND, TEXT_LINES = 0.08, 50
# Bare page numbers, beginnings of list items and cues, beginnings of bibliography entries.
PAGE_NUMBER = r"(?iu)^\s*(page\s*)?[-–—]?\s*\d{1,4}\s*[-–—]?\s*(of\s*\d+)?\s*$"
BLOCK_START = (
    r"(?iu)^\s*(?:[•●▪◦\-–*]\s+|\(?\d{1,3}[.)]\s+|\(?[a-z][.)]\s+|q\d+[.:)]|step\s*\d+|\[\d+\]|answer\s*[:.]|definition\s*[:.]|example\s*[:.]|note\s*[:.]|important\s*[:.])"
)
CITATION_START = r"^[A-Z][a-z]+,\s(?:[A-Z]\.\s?)+(?:,|&|\(|et al)"


def text_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, text, x0, y0): lines of plain texts, TEXT_LINES a page; blank lines stay as empty marks."""
    lines = documents.where("doc_id is not null").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("n", "line"))
    indent = F.length("line") - F.length(F.ltrim("line"))
    return lines.select("doc_id", (F.floor(F.col("n") / TEXT_LINES) + 1).cast("int").alias("page"), (F.col("n") % TEXT_LINES).alias("line_no"), F.trim("line").alias("text"),
                        (72.0 + 5.0 * indent).alias("x0"), (72.0 + 14.0 * (F.col("n") % TEXT_LINES)).alias("y0"))


def scanned_lines(ocr_lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines of scanned pages in the common schema of physical lines; page height from the page, 842 where there is none."""
    one = ocr_lines.where("document_id is not null").groupBy("document_id", "page", "line_no").agg(F.max(F.struct("text", "x0", "y0", "x1", "y1", "confidence", "height")).alias("l")).select("document_id", "page", "line_no", "l.*")
    sizes = pages.groupBy("document_id", F.col("page_number").alias("page")).agg(F.max("height").alias("page_height"))
    out = one.join(sizes, ["document_id", "page"], "left")
    return out.select("document_id", "page", "line_no", F.coalesce(T.normalise(F.col("text")), F.lit("")).alias("text"), "x0", "y0", "x1", "y1", F.col("height").alias("font_size"), F.lit(False).alias("is_bold"), F.lit("ocr").alias("source"),
                      F.col("confidence").alias("ocr_confidence"), F.coalesce("page_height", F.lit(842.0)).alias("page_height"))


def without_furniture(lines: DataFrame, band: float = BAND) -> DataFrame:
    """Lines without running heads and feet and bare page numbers.

    In documents of three pages and more a masked line (digits as #) that stands in the top or bottom band of max(2, pages div 2)
    distinct pages is repeated; repeats in the band go, and page numbers there. An anti join, so no page is gathered.
    """
    y = F.col("y0") / F.col("page_height")
    marked = lines.withColumn("_band", (F.col("page_height") > 0) & ((y < band) | (y > 1 - band))).withColumn("_mask", T.mask(F.col("text")))
    number = F.col("text").rlike(PAGE_NUMBER) & (F.col("_band") | (F.col("source") == "txt"))
    pages = marked.groupBy("document_id").agg(F.count_distinct("page").alias("_pages"))
    seen = marked.where("_band and text <> ''").groupBy("document_id", "_mask").agg(F.count_distinct("page").alias("_on"))
    repeated = seen.join(pages, "document_id").where((F.col("_pages") >= 3) & (F.col("_on") >= F.greatest(F.lit(2), F.floor(F.col("_pages") / 2)))).select("document_id", "_mask", F.lit(True).alias("_band"))
    return marked.where(~number).join(repeated, ["document_id", "_mask", "_band"], "left_anti").select(*lines.columns)


def leading(lines: DataFrame) -> DataFrame:
    """(document_id, lead_gap): median gap between consecutive lines of one size, 2.0 where there is none."""
    flow = Window.partitionBy("document_id").orderBy("page", "line_no")
    prev = lambda c: F.lag(c).over(flow)
    gap = F.when((prev("page") == F.col("page")) & (prev("text") != "") & (F.col("text") != "") & (F.abs(prev("font_size") - F.col("font_size")) < 0.6), F.col("y0") - prev("y1"))
    gaps = lines.select("document_id", F.when((gap > -2) & (gap < prev("font_size") * 2), gap).alias("g"))
    return gaps.groupBy("document_id").agg(F.coalesce(F.median("g"), F.lit(2.0)).alias("lead_gap"))


def merged(lines: DataFrame) -> DataFrame:
    """(document_id, order_index, page, text, x0, y0, x1, y1, font_size, is_bold, line_count, ocr_confidence, gap_before, gap_after).

    Wrapped lines become segments: a line starts a new one where it differs from the line before in page, size or weight, begins a
    list item, cue or bibliography entry, stands clearly apart, or follows a short line that ends a sentence. Blank lines end a segment.
    """
    flow = Window.partitionBy("document_id").orderBy("page", "line_no")
    spaced = lines.join(leading(lines), "document_id")
    prev = lambda c: F.lag(c).over(flow)
    pw, cw = prev("x1") - prev("x0"), F.col("x1") - F.col("x0")
    height = F.greatest(prev("y1") - prev("y0"), prev("font_size") * 1.1, F.lit(1.0))
    gap = F.col("y0") - prev("y1")
    new = (
        prev("page").isNull() | (prev("page") != F.col("page")) | (prev("text") == "") | (F.col("source") == "docx")
        | (F.abs(prev("font_size") - F.col("font_size")) > 0.6) | (prev("is_bold") != F.col("is_bold"))
        | F.col("text").rlike(BLOCK_START) | F.col("text").rlike(CITATION_START)
        | (gap > 0.9 * height) | (gap < -height)
        | ((prev("source") == "text_layer") & (gap > F.col("lead_gap") + 0.3 * prev("font_size")))
        | ((prev("source") != "txt") & (pw > 0) & prev("text").rlike("[.:!?]$") & (pw < 0.7 * F.greatest(cw, pw)))
    )
    marked = spaced.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int"))
    blocks = marked.withColumn("_block", F.sum("_new").over(flow)).where("text <> ''")
    own = F.array_sort(F.collect_list(F.struct("page", "line_no", "text")))
    out = blocks.groupBy("document_id", "_block").agg(
        F.min("page").alias("page"), own.alias("l"), *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")],
        F.median("font_size").alias("font_size"), F.min_by("is_bold", F.struct("page", "line_no")).alias("is_bold"), F.count("*").alias("line_count"), F.round(F.avg("ocr_confidence"), 1).alias("ocr_confidence"))
    out = out.withColumn("text", T.normalise(T.joined(F.transform("l", lambda x: x["text"])))).where("text <> ''")
    order, page = Window.partitionBy("document_id").orderBy("_block"), Window.partitionBy("document_id", "page").orderBy("_block")
    zero = F.lit(0.0)
    before = F.coalesce(F.round(F.greatest(zero, F.col("y0") - F.lag("y1").over(page)), 2), zero)
    after = F.coalesce(F.round(F.greatest(zero, F.lead("y0").over(page) - F.col("y1")), 2), zero)
    return out.select("document_id", (F.row_number().over(order) - 1).alias("order_index"), "page", "text", "x0", "y0", "x1", "y1", "font_size", "is_bold", "line_count", "ocr_confidence", before.alias("gap_before"), after.alias("gap_after"))


def lines_of_words(words: DataFrame) -> DataFrame:
    """(doc_id, page, block, par, line, text, x0, y0, x1, y1, confidence, height): recognised words to lines; words of confidence below 0 and blank ones are dropped."""
    kept = words.where((F.col("confidence") >= 0) & (F.trim("word") != ""))
    cells = F.array_sort(F.collect_list(F.struct("word_no", "word")))
    heights = F.array_sort(F.collect_list(F.col("y1") - F.col("y0")))
    out = kept.groupBy("doc_id", "page", "block", "par", "line").agg(cells.alias("w"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("confidence").alias("confidence"), heights.alias("h"))
    return out.select("doc_id", "page", "block", "par", "line", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"), "x0", "y0", "x1", "y1", F.round("confidence", 6).alias("confidence"), F.element_at("h", (F.floor(F.size("h") / 2) + 1).cast("int")).alias("height"))
