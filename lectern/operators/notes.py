"""Notes, exam sheets and assignments extracted from a section tree; outlines; alignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.segments import distinct_segments, order, tree
from lectern.operators import editor
from lectern.operators.study import definitions, key_sentences, phrases

# Headings that ask for nothing.
SKIP_ASSIGNMENT = r"(?iu)question|exercise|reference|bibliograph|source|conclusion|summary|self-test"
SKIP_EXAM = r"(?iu)question|reference|bibliograph|conclusion|summary"
MODES = ("clean", "smart", "simple")


def unnumbered(heading: Column) -> Column:
    return F.regexp_replace(heading, r"(?iu)^(chapter\s*)?[0-9.]+\s*[:.]?\s*", "")


def headings(segments: DataFrame) -> DataFrame:
    """(spec_id, ord, level, heading, page) of the sections in reading order; the document's title is none."""
    flow = order()
    s = distinct_segments(segments).withColumn("_t", F.sum((F.col("label") == "TITLE").cast("int")).over(flow))
    top = (F.col("label") == "HEADING") | ((F.col("label") == "TITLE") & (F.col("_t") > 1))
    s = s.withColumn("level", F.when(top, 1).when(F.col("label") == "SUBHEADING", 2)).where("level is not null")
    return s.select("spec_id", F.row_number().over(flow).alias("ord"), "level", F.col("text").alias("heading"), "page")


def shortest(text: Column) -> Column:
    """The sentences that are among the two shortest by words, in order."""
    s = T.sentences(text)
    ranked = F.slice(F.array_sort(F.transform(s, lambda x, i: F.struct(F.size(T.pieces(x)).alias("n"), i.alias("i"), x.alias("s")))), 1, 2)
    kept = F.transform(ranked, lambda x: x["s"])
    return F.filter(s, lambda x: F.array_contains(kept, x))


def notes(segments: DataFrame, mode: str = "smart") -> DataFrame:
    """(spec_id, section_seq, block, type, term, text): blocks of notes by label, successive bullets as one block with a line each.

    clean keeps paragraphs whole, smart takes their key sentences, simple their two shortest sentences.
    """
    items = tree(segments)
    label, text = F.col("label"), F.trim("text")
    said = F.coalesce(T.definition(T.strip_cue(text)), T.definition(text))
    kind = (
        F.when(label == "DEFINITION", "definition").when(label == "EXAMPLE", "example").when(label == "FORMULA", "formula").when(label == "IMPORTANT_POINT", "key_point")
        .when(label == "PROCEDURE", "numbered").when(label.isin("QUESTION", "ANSWER", "REFERENCE") | F.lit(mode == "clean"), "paragraph").otherwise("bullets")
    )
    rows = items.withColumn("type", kind).withColumn("_d", F.when(label == "DEFINITION", said))
    if mode == "smart":
        best = key_sentences(items).groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("_k"))
        rows = rows.join(best, "segment_id", "left").withColumn("_k", F.transform("_k", lambda x: x["sentence"]))
        rows = rows.withColumn("_k", F.when(label.isin("PARAGRAPH", "CONCLUSION"), F.col("_k")).otherwise(T.sentences(text)))
    else:
        rows = rows.withColumn("_k", shortest(text))
    body = (
        F.when(F.col("type") == "definition", F.coalesce(F.col("_d.definition"), T.strip_cue(text))).when(F.col("type").isin("example", "key_point"), T.strip_cue(text))
        .when(F.col("type") == "numbered", F.array_join(T.steps(text), "\n")).when(F.col("type") == "bullets", F.array_join("_k", "\n")).otherwise(text)
    )
    flow = Window.partitionBy("spec_id", "section_seq").orderBy("order_index", "segment_id")
    rows = rows.withColumn("_b", body).withColumn("_new", F.when((F.col("type") == "bullets") & (F.lag("type").over(flow) == "bullets"), 0).otherwise(1)).withColumn("block", F.sum("_new").over(flow))
    each = rows.groupBy("spec_id", "section_seq", "block").agg(F.first("type").alias("type"), F.first("_d.term").alias("term"), F.array_sort(F.collect_list(F.struct("order_index", "segment_id", "_b"))).alias("l"))
    return each.select("spec_id", "section_seq", "block", "type", "term", F.array_join(F.filter(F.transform("l", lambda x: x["_b"]), lambda x: x != ""), "\n").alias("text")).where("text <> ''")


def exam(segments: DataFrame) -> DataFrame:
    """(spec_id, part, ord, name, text): definitions, formulas, and at most ten questions, those of the text first, then one for each
    section until there are eight."""
    t = tree(segments)
    d = definitions(segments).select("spec_id", F.lit("definition").alias("part"), F.col("ord").cast("long").alias("ord"), F.col("term").alias("name"), F.col("definition").alias("text"))
    flow = Window.partitionBy("spec_id").orderBy("order_index", "segment_id")
    f = t.where("label = 'FORMULA'").select("spec_id", F.lit("formula"), F.row_number().over(flow).cast("long"), F.when(F.col("text").contains("="), F.left(F.trim(F.substring_index("text", "=", 1)), F.lit(60))).otherwise("Formula"), "text")
    asked = t.where("label = 'QUESTION'").select("spec_id", F.row_number().over(flow).alias("n"), T.strip_cue(F.col("text")).alias("text"))
    held = asked.groupBy("spec_id").agg(F.count("*").alias("held"))
    h = headings(segments).where((F.trim("heading") != "") & ~F.col("heading").rlike(SKIP_EXAM))
    h = h.withColumn("r", F.row_number().over(Window.partitionBy("spec_id").orderBy("ord"))).join(held, "spec_id", "left").withColumn("n", F.coalesce("held", F.lit(0)) + F.col("r")).where("n <= 8")
    made = h.select("spec_id", "n", F.concat(F.lit("Explain the key ideas of '"), unnumbered(F.col("heading")), F.lit("'.")).alias("text"))
    q = asked.unionByName(made).where("n <= 10").select("spec_id", F.lit("question"), F.col("n").cast("long"), F.lit(None).cast("string"), "text")
    return d.union(f).union(q)


def objectives(segments: DataFrame) -> DataFrame:
    """(spec_id, ord, text): what an assignment asks for, from the first five top headings."""
    h = headings(segments).where((F.col("level") == 1) & (F.trim("heading") != "") & ~F.col("heading").rlike(SKIP_ASSIGNMENT))
    r = F.row_number().over(Window.partitionBy("spec_id").orderBy("ord"))
    return h.withColumn("n", r).where("n <= 5").select("spec_id", F.col("n").alias("ord"), F.concat(F.lit("Explain "), F.lower(unnumbered(F.col("heading")))).alias("text"))


def titles(segments: DataFrame) -> DataFrame:
    """(spec_id, title): the text of the first TITLE; empty without one."""
    first = F.min(F.when(F.col("label") == "TITLE", F.struct("order_index", "segment_id", "text")))
    return distinct_segments(segments).groupBy("spec_id").agg(first.alias("x")).select("spec_id", F.coalesce("x.text", F.lit("")).alias("title"))


def assignment(segments: DataFrame) -> DataFrame:
    """(spec_id, part, ord, text): introduction (two key sentences of the first paragraph), objectives, examples, conclusion, references; what is
    missing is made from the title. The main sections are notes(segments, "smart") but for headings that ask for nothing."""
    t, own = tree(segments), titles(segments)
    flow = Window.partitionBy("spec_id").orderBy("order_index", "segment_id")
    back = Window.partitionBy("spec_id").orderBy(F.desc("order_index"), F.desc("segment_id"))
    par = t.where("label = 'PARAGRAPH'").withColumn("a", F.row_number().over(flow)).withColumn("b", F.row_number().over(back)).where("a = 1 or b = 1").select("segment_id", "a", "b")
    best = key_sentences(t, 2).join(par, "segment_id").join(t.select("segment_id", "spec_id"), "segment_id")
    said = lambda rows, part: rows.groupBy("spec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("s")).withColumn("part", F.lit(part))
    last = key_sentences(t, 1).join(par, "segment_id").join(t.select("segment_id", "spec_id"), "segment_id").where("b = 1")
    one = lambda part, text: own.join(text, "spec_id", "left").select("spec_id", F.lit(part).alias("part"), F.lit(1).cast("long").alias("ord"), "title", "s")
    intro = one("introduction", said(best.where("a = 1"), "x")).select("spec_id", "part", "ord", F.coalesce("s", F.concat(F.lit("This assignment discusses "), F.col("title"), F.lit("."))).alias("text"))
    asked = objectives(segments).select("spec_id", F.lit("objective").alias("part"), F.col("ord").cast("long").alias("ord"), "text")
    none = own.join(asked.select("spec_id").distinct(), "spec_id", "left_anti").select("spec_id", F.lit("objective"), F.lit(1).cast("long"), F.concat(F.lit("Understand "), F.col("title")))
    ends = t.where("label = 'CONCLUSION'").groupBy("spec_id").agg(F.min(F.struct("order_index", "segment_id", "text")).alias("x")).select("spec_id", F.col("x.text").alias("c"))
    conclusion = one("conclusion", said(last, "x")).join(ends, "spec_id", "left").select("spec_id", "part", "ord", F.coalesce("c", "s", F.lit("")).alias("text"))
    rest = t.where("label in ('EXAMPLE', 'REFERENCE')").withColumn("ord", F.row_number().over(Window.partitionBy("spec_id", "label").orderBy("order_index", "segment_id")).cast("long"))
    rest = rest.select("spec_id", F.lower("label").alias("part"), "ord", F.when(F.col("label") == "EXAMPLE", T.strip_cue(F.col("text"))).otherwise(F.col("text")).alias("text"))
    return intro.union(asked).union(none).union(conclusion).union(rest)


_ROW = ("spec_id", "seq", "at", "kind", "level", "align", "lines")


def _row(rows: DataFrame, seq: Column, at: Column, kind: Column, lines: Column, level: Column | None = None, align: Column | None = None) -> DataFrame:
    nothing = F.lit(None)
    return rows.select("spec_id", seq.cast("long").alias("seq"), at.cast("long").alias("at"), kind.alias("kind"), (nothing if level is None else level).cast("int").alias("level"),
                       (nothing if align is None else align).cast("string").alias("align"), lines.alias("lines"))


def _sections(segments: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """(headings, blocks) of notes as rows of editor.compose, with the heading's text: sections without blocks and parts are left out."""
    n = notes(segments, mode)
    seq, text, term = F.col("section_seq"), T.clean_markup(F.col("text")), T.clean_markup(F.col("term"))
    each = F.transform(F.split("text", "\n"), T.clean_markup)
    kind = F.when(F.col("type") == "bullets", "bullet_list").when(F.col("type") == "numbered", "ordered_list").otherwise("paragraph")
    cue = lambda name, pattern: F.when(text.rlike(pattern), text).otherwise(F.concat(F.lit(f"{name}: "), text))
    one = F.when((F.col("type") == "definition") & (term != ""), F.concat(term, F.lit(": "), text)).when(F.col("type") == "example", cue("Example", r"(?i)^(example|e\.g\.)")).when(
        F.col("type") == "key_point", cue("Key point", "(?i)^(important|note|key point|remember)"))
    blocks = _row(n, seq, F.col("block"), kind, F.when(one.isNotNull(), F.array(one)).otherwise(each), None, F.when(F.col("type") == "formula", "center"))
    h = headings(segments)
    nxt = F.lead("level").over(Window.partitionBy("spec_id").orderBy("ord"))
    h = h.withColumn("parent", (F.col("level") == 1) & (F.coalesce(nxt, F.lit(0)) == 2)).withColumnRenamed("ord", "section_seq")
    full = n.select("spec_id", "section_seq").distinct().withColumn("full", F.lit(True))
    h = h.join(full, ["spec_id", "section_seq"], "full").where("coalesce(full, false) or coalesce(parent, false)")
    name = F.when(seq == 0, "Introduction").when(F.trim(F.coalesce("heading", F.lit(""))) == "", "Notes").otherwise(F.col("heading"))
    heads = _row(h, seq, F.lit(0), F.lit("heading"), F.array(T.clean_markup(name)), F.least(F.coalesce("level", F.lit(1)) + 1, F.lit(3)))
    return heads, blocks


def _titled(segments: DataFrame, other: str, suffix: str = "") -> tuple[DataFrame, DataFrame]:
    own = titles(segments).select("spec_id", F.coalesce(F.nullif(T.clean_markup(F.concat("title", F.lit(suffix))), F.lit("")), F.lit(other)).alias("title"))
    return own, _row(own, F.lit(-1), F.lit(0), F.lit("heading"), F.array("title"), F.lit(1))


def documents(segments: DataFrame, mode: str = "smart") -> DataFrame:
    """(spec_id, content): editable documents: notes (clean, smart, simple), assignment, exam, or preserve, which keeps all text and its order."""
    flow = Window.partitionBy("spec_id").orderBy("order_index", "segment_id")
    part = lambda seq, name: (lambda rows: _row(rows.select("spec_id").distinct(), F.lit(seq), F.lit(0), F.lit("heading"), F.array(F.lit(name)), F.lit(2)))
    listed = lambda rows, seq, kind: _row(rows.groupBy("spec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: T.clean_markup(x["text"])).alias("l")), F.lit(seq), F.lit(1), F.lit(kind), F.col("l"))
    each = lambda rows, seq, lines, align=None: _row(rows, F.lit(seq), F.col("ord"), F.lit("paragraph"), lines, None, align)
    clean = F.array(T.clean_markup(F.col("text")))
    if mode in MODES:
        own, rows = _titled(segments, "Notes")
        for r in _sections(segments, mode):
            rows = rows.unionByName(r)
    elif mode == "assignment":
        own, rows = _titled(segments, "Assignment")
        a = assignment(segments).where(T.clean_markup(F.col("text")) != "")
        of = lambda name: a.where(F.col("part") == name)
        rows = rows.unionByName(part(0, "Introduction")(own)).unionByName(each(of("introduction"), 0, clean)).unionByName(part(1, "Objectives")(of("objective"))).unionByName(listed(of("objective"), 1, "ordered_list"))
        heads, blocks = _sections(segments, "smart")
        heads = heads.where(~F.col("lines")[0].rlike(SKIP_ASSIGNMENT))
        kept = blocks.join(heads.select("spec_id", "seq"), ["spec_id", "seq"], "left_semi")
        for r in (heads, kept):
            rows = rows.unionByName(r.withColumn("seq", F.col("seq") + 10))
        for k, (name, title) in enumerate((("example", "Examples"), ("conclusion", "Conclusion"), ("reference", "References"))):
            rows = rows.unionByName(part((1 << 40) + k, title)(of(name))).unionByName(each(of(name), (1 << 40) + k, clean))
    elif mode == "exam":
        own, rows = _titled(segments, "Exam Revision", " — Exam Revision")
        e = exam(segments)
        of = lambda name: e.where(F.col("part") == name)
        formula = tree(segments).where("label = 'FORMULA'").select("spec_id", F.row_number().over(flow).alias("ord"), "text", F.concat(F.lit("Formula from page "), F.col("page").cast("string"), F.lit(".")).alias("meaning"))
        named = F.array(F.concat(T.clean_markup(F.col("name")), F.lit(": "), T.clean_markup(F.col("text"))))
        rows = rows.unionByName(part(0, "Key Definitions")(of("definition"))).unionByName(each(of("definition"), 0, named)).unionByName(part(1, "Formulas")(formula))
        rows = rows.unionByName(each(formula.withColumn("ord", F.col("ord") * 2), 1, clean, F.lit("center"))).unionByName(each(formula.withColumn("ord", F.col("ord") * 2 + 1), 1, F.array("meaning")))
        concepts = phrases(segments).select("spec_id", F.col("rank").alias("ord"), F.lower("phrase").alias("text"))
        rows = rows.unionByName(part(2, "Key Concepts")(concepts)).unionByName(listed(concepts, 2, "bullet_list")).unionByName(part(3, "Important Questions")(of("question"))).unionByName(listed(of("question"), 3, "ordered_list"))
    else:
        own, rows = titles(segments), _row(titles(segments), F.lit(-1), F.lit(0), F.lit("heading"), F.array("title"), F.lit(1))
        bullet = r"^\s*[•●▪◦\-–*]\s+"
        t = tree(segments).withColumn("b", F.col("text").rlike(bullet))
        inside = Window.partitionBy("spec_id", "section_seq").orderBy("order_index", "segment_id")
        t = t.withColumn("n", F.sum(F.when(F.col("b") & F.coalesce(F.lag("b").over(inside), F.lit(False)), 0).otherwise(1)).over(inside))
        g = t.groupBy("spec_id", "section_seq", "n", "b").agg(F.array_sort(F.collect_list(F.struct("order_index", "segment_id", "text", "label"))).alias("l"))
        lines = F.transform("l", lambda x: F.regexp_replace(x["text"], bullet, ""))
        rows = rows.unionByName(_row(g, F.col("section_seq"), F.col("n"), F.when(F.col("b"), "bullet_list").otherwise("paragraph"), F.when(F.col("b"), lines).otherwise(F.transform("l", lambda x: x["text"])), None, F.when(F.col("l")[0]["label"] == "FORMULA", "center")))
        h = headings(segments)
        rows = rows.unionByName(_row(h, F.col("ord"), F.lit(0), F.lit("heading"), F.array("heading"), F.col("level") + 1))
    flat = F.transform("lines", lambda x: F.regexp_replace(x, r"[\r\n]+", " "))
    return editor.compose(rows.withColumn("lines", flat), "spec_id", ["seq", "at"], own)


def joined_parts(parts: DataFrame) -> DataFrame:
    """(spec_id, section_seq, ...) of notes made part by part, parts(spec_id, part, section_seq, block, ...): sections numbered on through the parts."""
    size = parts.groupBy("spec_id", "part").agg((F.max("section_seq") + 1).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("spec_id").orderBy("part")) - F.col("_n")
    return parts.join(size.withColumn("_before", before), ["spec_id", "part"]).withColumn("section_seq", F.col("section_seq") + F.col("_before")).drop("_n", "_before", "part")


def outline(segments: DataFrame, limit: int = 400_000) -> DataFrame:
    """(spec_id, text): headings and items with label and page, a line each, cut at `limit` characters."""
    h = distinct_segments(segments)
    mark = F.when(F.col("label").isin("TITLE", "HEADING"), "# ").when(F.col("label") == "SUBHEADING", "## ").otherwise(F.concat(F.lit("["), F.coalesce("label", F.lit("PARAGRAPH")), F.lit(" p."), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit("] ")))
    lines = h.groupBy("spec_id").agg(F.array_sort(F.collect_list(F.struct("order_index", "segment_id", F.concat(mark, "text").alias("l")))).alias("l"))
    return lines.select("spec_id", F.left(F.array_join(F.transform("l", lambda x: x["l"]), "\n"), F.lit(limit)).alias("text"))


def outline_parts(outlines: DataFrame, limit: int = 60_000) -> DataFrame:
    """(spec_id, part, text): an outline in parts of at most about `limit` characters; a part over 60 % full ends before a top heading."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(s: Column, line: Column) -> Column:
        full = (F.length(s["cur"]) > 0) & ((F.length(s["cur"]) + F.length(line) + 1 > limit) | (line.startswith("# ") & (F.length(s["cur"]) > 0.6 * limit)))
        return F.when(full, F.struct(F.concat(s["done"], F.array(s["cur"])).alias("done"), line.alias("cur"))).otherwise(
            F.struct(s["done"].alias("done"), F.when(F.length(s["cur"]) == 0, line).otherwise(F.concat(s["cur"], F.lit("\n"), line)).alias("cur")))

    parts = F.aggregate(F.split("text", "\n"), start, step, lambda s: F.concat(s["done"], F.array(s["cur"])))
    return outlines.select("spec_id", F.posexplode(parts).alias("part", "text"))


def aligned(segments: DataFrame, blocks: DataFrame, ahead: int = 4) -> DataFrame:
    """(doc_id, order_index, label): labels of source blocks given to extracted segments, in sequence.

    A segment matches the next of `ahead` blocks whose letters and digits equal its own or share their first 40. The position moves
    with each match, so each document is folded. segments(doc_id, order_index, text), blocks(doc_id, n, label, text).
    """
    import re

    bare = lambda t: re.sub(r"[^a-z0-9]", "", (t or "").lower())

    def fold(key: tuple, own: pd.DataFrame, source: pd.DataFrame) -> pd.DataFrame:
        own, source = own.sort_values("order_index"), source.sort_values("n")
        keys, labels, at, out = [bare(t) for t in source.text], source.label.tolist(), 0, []
        for r in own.itertuples():
            s, hit = bare(r.text), None
            for j in range(at, min(at + ahead, len(keys))):
                k = keys[j]
                if s and (s == k or s[:40] == k[:40] or len(s) >= 40 and k.startswith(s[:40]) or len(k) >= 40 and s.startswith(k[:40])):
                    hit, at = labels[j], j + 1
                    break
            out.append((key[0], r.order_index, hit))
        return pd.DataFrame(out, columns=["doc_id", "order_index", "label"])

    kind, number = dict(segments.dtypes)["doc_id"], dict(segments.dtypes)["order_index"]
    return segments.groupBy("doc_id").cogroup(blocks.groupBy("doc_id")).applyInPandas(fold, f"doc_id {kind}, order_index {number}, label string")
