"""Lines and pages of running text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.runtime import folded

WIDTH, LINES = 80, 40


def wrapped(text: Column, width: int = WIDTH) -> Column:
    """Lines of at most `width` characters, words placed first-fit; a longer word is broken at the width; line feeds are hard breaks."""
    words = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\n", " \n "), "[ \\t]+"), lambda w: w != "")
    parts = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(w), F.lit(1)) - 1) / width).cast("int")), lambda i: F.substr(w, i * width + 1, F.lit(width)))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(s: Column, w: Column) -> Column:
        fits = F.length(s["cur"]) + 1 + F.length(w) <= width
        return (
            F.when(w == "\n", F.struct(F.concat(s["done"], F.array(s["cur"])).alias("done"), F.lit("").alias("cur")))
            .when(s["cur"] == "", F.struct(s["done"].alias("done"), w.alias("cur")))
            .when(fits, F.struct(s["done"].alias("done"), F.concat(s["cur"], F.lit(" "), w).alias("cur")))
            .otherwise(F.struct(F.concat(s["done"], F.array(s["cur"])).alias("done"), w.alias("cur")))
        )

    return F.aggregate(parts, start, step, lambda s: F.concat(s["done"], F.array(s["cur"])))


def pages(blocks: DataFrame, key: str, width: int = WIDTH, lines: int = LINES) -> DataFrame:
    """(key, ord, line, page, slot, text): blocks(key, ord, text) as lines on pages of `lines` slots, a blank slot after each block.

    Slots are counted by a running sum over the blocks of a document, so that a document of any length is laid out in one pass.
    """
    own = Window.partitionBy(key).orderBy("ord")
    rows = blocks.select(key, "ord", wrapped(F.col("text"), width).alias("l"))
    first = F.sum(F.size("l") + 1).over(own) - F.size("l") - 1
    out = rows.withColumn("_f", first).select(key, "ord", "_f", F.posexplode("l").alias("line", "text"))
    slot = F.col("_f") + F.col("line")
    return out.select(key, "ord", "line", (F.floor(slot / lines) + 1).cast("int").alias("page"), (slot % lines).cast("int").alias("slot"), "text")


def spans_to_lines(spans: DataFrame) -> DataFrame:
    """(doc_id, page, line, text, font, size, is_bold, is_italic, x0, y0, x1, y1): spans of text to lines; the span with most characters
    names font and size, a style holds if more than half of the characters have it. Lines come in reading order by (y / 3, x)."""
    n = F.length("text")
    bold = (F.col("flags").bitwiseAND(16) != 0) | F.col("font").rlike("(?i)bold|black|heavy")
    italic = (F.col("flags").bitwiseAND(2) != 0) | F.col("font").rlike("(?i)italic|oblique")
    s = spans.withColumns({"_n": n, "_b": F.when(bold, n).otherwise(0), "_i": F.when(italic, n).otherwise(0)})
    out = s.groupBy("doc_id", "page", "line").agg(
        F.array_sort(F.collect_list(F.struct("span", "text"))).alias("l"), F.max_by("font", F.struct("_n", -F.col("span"))).alias("font"), F.max_by("size", F.struct("_n", -F.col("span"))).alias("size"),
        (F.sum("_b") * 2 > F.sum("_n")).alias("is_bold"), (F.sum("_i") * 2 > F.sum("_n")).alias("is_italic"), *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")])
    flow = Window.partitionBy("doc_id", "page").orderBy(F.bround(F.col("y0") / 3), "x0", "line")
    return out.select("doc_id", "page", F.row_number().over(flow).alias("line"), F.array_join(F.transform("l", lambda x: x["text"]), "").alias("text"), "font", "size", "is_bold", "is_italic", "x0", "y0", "x1", "y1")


def characters_to_lines(chars: DataFrame) -> DataFrame:
    """(doc_id, page, line, text): drawn characters in order; a new line begins where the baseline moves by more than half of the size."""
    flow = Window.partitionBy("doc_id", "page").orderBy("n")
    new = F.coalesce((F.abs(F.col("y") - F.lag("y").over(flow)) > 0.5 * F.greatest("size", F.lag("size").over(flow))).cast("int"), F.lit(0))
    rows = chars.withColumn("_new", new).withColumn("line", F.sum("_new").over(flow))
    return rows.groupBy("doc_id", "page", "line").agg(F.array_sort(F.collect_list(F.struct("n", "c"))).alias("l")).select("doc_id", "page", "line", F.array_join(F.transform("l", lambda x: x["c"]), "").alias("text"))


def measured(text: Column, advances: dict[str, float], size: float = 1.0, other: float = 0.5) -> Column:
    """Width of a text at a font size: the sum of its characters' advances (of one em), `other` for a character that the font's table lacks."""
    from itertools import chain

    table = F.create_map(*chain(*((F.lit(c), F.lit(float(w))) for c, w in advances.items())))
    return F.aggregate(F.split(text, ""), F.lit(0.0), lambda s, c: s + F.when(c == "", 0.0).otherwise(F.coalesce(F.try_element_at(table, c), F.lit(float(other))))) * size


def wrapped_by_advance(text: Column, advances: dict[str, float], width: float, size: float = 1.0, other: float = 0.5) -> Column:
    """Lines no wider than `width`: words first-fit by their advances, line feeds as hard breaks; a word that is wider stands alone."""
    words = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\n", " \n "), "[ \\t]+"), lambda w: w != "")
    sized = F.transform(words, lambda w: F.struct(w.alias("t"), measured(w, advances, size, other).alias("w")))
    blank = measured(F.lit(" "), advances, size, other)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0.0).alias("w"))

    def step(s: Column, x: Column) -> Column:
        closed = F.concat(s["done"], F.array(s["cur"]))
        return (
            F.when(x["t"] == "\n", F.struct(closed.alias("done"), F.lit("").alias("cur"), F.lit(0.0).alias("w")))
            .when(s["cur"] == "", F.struct(s["done"].alias("done"), x["t"].alias("cur"), x["w"].alias("w")))
            .when(s["w"] + blank + x["w"] <= width, F.struct(s["done"].alias("done"), F.concat(s["cur"], F.lit(" "), x["t"]).alias("cur"), (s["w"] + blank + x["w"]).alias("w")))
            .otherwise(F.struct(closed.alias("done"), x["t"].alias("cur"), x["w"].alias("w")))
        )

    return F.aggregate(sized, start, step, lambda s: F.concat(s["done"], F.array(s["cur"])))


def paginated(blocks: DataFrame, key: str, lines: int = LINES, together: int = 2) -> DataFrame:
    """(key, ord, line, page, slot): lines of blocks(key, ord, kind, lines: their number) on pages of `lines` slots, a blank slot between blocks.

    A heading stays on the page of the first `together` lines of the block behind it; a block is broken so that at least `together` of its lines are
    on either page, and is moved whole where that can't be. Where a block lands depends on those before it, so the blocks of a
    document are folded in order; a heading waits for the block that it stands over.
    """
    kind = dict(blocks.dtypes)[key]

    def begin() -> dict:
        return {"page": 1, "slot": 0, "heads": []}

    def fresh(s: dict) -> None:
        s["page"], s["slot"] = s["page"] + 1, 0

    def place(s: dict, k: object, ord_: int, count: int, keep: int) -> list[tuple]:
        """Lines of one block; `keep` of them have to be where the first is."""
        if s["slot"] and s["slot"] + keep > lines:
            fresh(s)
        out = []
        for i in range(count):
            left = count - i
            if s["slot"] >= lines or s["slot"] and i and left <= together < count and s["slot"] + left > lines and i >= together:
                fresh(s)
            out.append((k, ord_, i, s["page"], s["slot"]))
            s["slot"] += 1
        s["slot"] += 1
        return out

    def flush(s: dict, k: object, block: tuple | None) -> list[tuple]:
        heads, s["heads"] = s["heads"], []
        first = min(together, block[1]) if block else 0
        need = sum(n + 1 for _, n in heads) + first - (0 if block else 1)
        if heads and s["slot"] and need <= lines and s["slot"] + need > lines:
            fresh(s)
        out = [r for o, n in heads for r in place(s, k, o, n, n)]
        if block:
            o, n = block
            out += place(s, k, o, n, n if n < 2 * together else together)
        return out

    def step(s: dict, r: tuple) -> list[tuple]:
        if r.kind == "heading":
            s["heads"].append((r.ord, r.lines))
            return []
        return flush(s, getattr(r, key), (r.ord, r.lines))

    return folded(blocks.select(key, "ord", "kind", "lines"), key, ["ord"], begin, step, f"{key} {kind}, ord long, line int, page int, slot int", lambda k, s: flush(s, k, None))
