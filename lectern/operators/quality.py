"""Checks of page geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the bins that make a range join an equi-join.
BIN = 64.0


def luminance(r: Column, g: Column, b: Column) -> Column:
    one = lambda c: F.when(c / 255.0 <= 0.03928, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * one(r) + 0.7152 * one(g) + 0.0722 * one(b)


def contrast(a: Column, b: Column) -> Column:
    """WCAG contrast ratio of two luminances."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def overflow(boxes: DataFrame, margin: float = 0.0) -> DataFrame:
    """(document_id, page, line_no): boxes that leave their page."""
    out = (F.col("x0") < margin) | (F.col("y0") < margin) | (F.col("x1") > F.col("page_width") - margin) | (F.col("y1") > F.col("page_height") - margin)
    return boxes.where(out).select("document_id", "page", "line_no")


def collisions(boxes: DataFrame, slack: float = 0.0) -> DataFrame:
    """(document_id, page, line_a, line_b): boxes of one page that overlap in both directions, by a join on vertical bins.

    A box is put in every bin that it touches; a pair counts in the bin of its lower top edge alone, so that it comes once.
    """
    low, high = F.floor(F.col("y0") / BIN), F.floor(F.greatest("y1", "y0") / BIN)
    b = boxes.where("y0 is not null and y1 is not null").withColumn("bin", F.explode(F.sequence(low, high)))
    pick = lambda s: b.select("document_id", "page", "bin", *[F.col(c).alias(f"{c}_{s}") for c in ("line_no", "x0", "y0", "x1", "y1")])
    hit = pick("a").join(pick("b"), ["document_id", "page", "bin"]).where(
        (F.col("line_no_a") < F.col("line_no_b")) & (F.col("x0_a") + slack < F.col("x1_b")) & (F.col("x0_b") + slack < F.col("x1_a"))
        & (F.col("y0_a") + slack < F.col("y1_b")) & (F.col("y0_b") + slack < F.col("y1_a")) & (F.col("bin") == F.floor(F.greatest("y0_a", "y0_b") / BIN)))
    return hit.select("document_id", "page", F.col("line_no_a").alias("line_a"), F.col("line_no_b").alias("line_b"))


def lonely_lines(segments: DataFrame, headings: tuple[str, ...] = ("HEADING", "SUBHEADING", "TITLE")) -> DataFrame:
    """(spec_id, page, segment_id): pages whose last segment is a heading while the document goes on."""
    own = Window.partitionBy("spec_id").orderBy("order_index", "segment_id")
    s = segments.select("spec_id", "page", "segment_id", "label", F.lead("page").over(own).alias("next"))
    return s.where((F.col("next") > F.col("page")) & F.col("label").isin(*headings)).select("spec_id", "page", "segment_id")


def page_metrics(boxes: DataFrame) -> DataFrame:
    """(document_id, page, lines, fill_ratio, min_height): lines, share of the page's height between first and last line, smallest line."""
    return boxes.groupBy("document_id", "page").agg(F.count("*").alias("lines"), F.round((F.max("y1") - F.min("y0")) / F.max("page_height"), 6).alias("fill_ratio"), F.min("height").alias("min_height"))


def underline_faults(glyphs: DataFrame, strokes: DataFrame, slack: float = 0.01) -> DataFrame:
    """(page, line_id, x1): strokes drawn under a glyph that isn't marked as underlined: joined by line, then by range. glyphs(page, line_id, x,
    advance, underline, marker), strokes(page, line_id, x1, x2)."""
    g = glyphs.where("not marker and not underline").select("page", "line_id", "x", "advance")
    inside = (F.col("x") >= F.col("x1") - slack) & (F.col("x") + F.col("advance") <= F.col("x2") + slack)
    return strokes.join(g, ["page", "line_id"]).where(inside).select("page", "line_id", "x1").distinct()


def audit(drawn: DataFrame, key: str) -> DataFrame:
    """(key, code, severity): what a drawn document read back has against what was to be drawn.

    drawn(key, expected, got: texts; pages, pages_got; underlines, underlines_got; meta, meta_got: maps). Other words are an error if the texts are
    less than 99.5 % alike or more than two, or one in 200, words are missing, else a warning.
    """
    from lectern.operators.store import token_diff

    d = token_diff(drawn, key, "expected", "got")
    n = F.size(F.filter(F.split(F.coalesce("expected", F.lit("")), r"\s+"), lambda w: w != ""))
    rows = drawn.join(d, key)
    other = (F.col("added") > 0) | (F.col("removed") > 0)
    bad = (F.col("ratio") < 0.995) | (F.col("removed") > F.greatest(F.lit(2), F.floor(n / 200)))
    said = F.map_keys("meta")
    lost = F.size(F.filter(said, lambda k: ~F.try_element_at("meta_got", k).eqNullSafe(F.try_element_at("meta", k)))) > 0
    one = lambda ok, code, level="error": F.when(ok, F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity")))
    found = F.array_compact(F.array(
        F.when(other & bad, F.struct(F.lit("CONTENT_MISMATCH").alias("code"), F.lit("error").alias("severity"))).when(other, F.struct(F.lit("TEXT_EXTRACTION").alias("code"), F.lit("warning").alias("severity"))),
        one(F.col("underlines") != F.col("underlines_got"), "UNDERLINE_MISMATCH"), one(F.col("pages") != F.col("pages_got"), "PAGE_COUNT"), one(lost, "METADATA")))
    return rows.select(key, F.inline(found))


def layout_issues(lines: DataFrame, tokens: DataFrame, least: float = 9.0) -> DataFrame:
    """(document_id, code, page): faults of laid-out documents: EMPTY_PAGE (no line with text), ORPHAN_HEADING (the last line of a page that another
    follows is a heading), WIDOW_LINE (the first line of a page ends a block of more lines and nothing of it follows), TEXT_TOO_SMALL, CONTENT_CHANGED
    (other words than the document's).

    lines(document_id, page, line, kind: heading, text or empty, text, size, block, last: whether it ends its block), tokens(document_id, expected).
    """
    own, page = Window.partitionBy("document_id"), Window.partitionBy("document_id", "page")
    flow = page.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = lines.where("kind <> 'empty'").withColumn("end", F.last("line").over(flow)).withColumn("begin", F.first("line").over(flow)).withColumn("pages", F.max("page").over(own))
    s = s.withColumn("before", F.lag("block").over(own.orderBy("page", "line")))
    issue = lambda rows, code: rows.select("document_id", F.lit(code).alias("code"), "page").distinct()
    empty = lines.groupBy("document_id", "page").agg(F.count_if(F.col("kind") != "empty").alias("n")).where("n = 0")
    said = lines.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "text"))), lambda x: x["text"]).alias("l"))
    split = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    changed = tokens.join(said, "document_id", "left").where(~split(F.array_join(F.coalesce("l", F.array().cast("array<string>")), " ")).eqNullSafe(split(F.coalesce("expected", F.lit("")))))
    out = [issue(empty, "EMPTY_PAGE"), issue(s.where("kind = 'heading' and line = end and page < pages"), "ORPHAN_HEADING"), issue(s.where("line = begin and last and before = block and page > 1"), "WIDOW_LINE"),
           issue(s.where(F.col("size") < least), "TEXT_TOO_SMALL"), changed.select("document_id", F.lit("CONTENT_CHANGED").alias("code"), F.lit(None).cast(dict(lines.dtypes)["page"]).alias("page"))]
    every = out[0]
    for rows in out[1:]:
        every = every.unionByName(rows)
    return every
