"""Features, rule labels, section tree and chunks of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

TARGET, OVERLAP = 350, 50
PAGE_HEIGHT, PAGE_WIDTH = 842.0, 595.0
# Labels of segments.
LABELS = "TITLE HEADING SUBHEADING PARAGRAPH DEFINITION EXAMPLE PROCEDURE IMPORTANT_POINT FORMULA QUESTION ANSWER CONCLUSION REFERENCE".split()
# Cues of segments; `^` patterns look at the beginning only.
MATH = "=+−-×*/÷^²³√∑Σ∫πθλμσΔ≤≥≈≠<>()[]{}|"
CUES = {
    "starts_bullet": r"^\s*(?:[•●▪◦\-–*])\s+",
    "starts_number": r"^\s*\(?(\d{1,3})[.)]\s+",
    "starts_subnumber": r"^\s*\d{1,3}\.\d{1,3}(\.\d{1,3})?\.?\s+",
    "starts_qprefix": r"(?iu)^\s*(q\s*\d+|question\s*\d*)\s*[.:)]",
    "starts_aprefix": r"(?iu)^\s*(ans(wer)?|solution|sol)\s*[.:)\-]",
    "def_pattern": r"(?iu)\b(is defined as|refers to|is called|is known as|means that|definition)\b",
    "ex_pattern": r"(?iu)^\s*(e\.g\.|example|for example|for instance|consider|illustration)\b",
    "proc_pattern": r"(?iu)\b(step\s*\d+|first,|then,|next,|finally,|procedure|method:)",
    "imp_pattern": r"(?iu)^\s*(important|note|remember|key point|caution|warning|tip)\b",
    "conc_pattern": r"(?iu)^\s*(in conclusion|to conclude|in summary|to summari[sz]e|overall|thus,|therefore,|conclusion)\b",
    "imperative_q": r"(?iu)^\s*(explain|describe|discuss|define|compare|what|why|how|which|state|list|calculate|derive|name)\b",
}
REFERENCE = r"(?iu)(\[\d+\]|\(\d{4}\)|\b(19|20)\d{2}\b|et al\.|doi:|https?://|pp\.|vol\.)"


def distinct_segments(segments: DataFrame) -> DataFrame:
    """Each segment_id once; NULL text as empty text. Rows without segment or spec id are dropped."""
    rest = [c for c in segments.columns if c not in ("segment_id", "text")]
    rows = segments.where("segment_id is not null and spec_id is not null").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.groupBy("segment_id").agg(F.max(F.struct("text", *rest)).alias("x")).select("segment_id", "x.*")


def order(key: str = "spec_id") -> Window:
    return Window.partitionBy(key).orderBy("order_index", "segment_id")


def _flag(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def features(segments: DataFrame) -> DataFrame:
    """segment_id, spec_id and the layout, cue and context features of a segment, doubles rounded to 6 places.

    Median and largest font are taken per document without a gathered list; neighbours come from one window.
    """
    s = distinct_segments(segments)
    flow, own = order(), Window.partitionBy("spec_id")
    t, size = F.col("text"), F.coalesce("font_size", F.lit(0.0))
    bare = F.regexp_replace(t, r"\s+", "")
    letters = F.regexp_replace(t, r"[^\p{L}]+", "")
    count = lambda pattern, x: F.length(x) - F.length(F.regexp_replace(x, pattern, ""))
    ratio = lambda pattern, x: F.when(F.length(x) > 0, count(pattern, x) / F.length(x)).otherwise(0.0)
    parts = T.pieces(t)
    named = F.filter(parts, lambda w: w.rlike(r"^\p{L}"))
    median = F.coalesce(F.nullif(F.col("_median"), F.lit(0.0)), F.lit(11.0))
    sizes = s.groupBy("spec_id").agg(F.median("font_size").alias("_median"), F.max("font_size").alias("_max"), F.count("*").alias("_n"))
    base = s.join(sizes, "spec_id").withColumn("_i", F.row_number().over(flow) - 1)
    end = F.regexp_replace(t, r"\s+$", "")
    gap = F.least(F.coalesce("gap_before", F.lit(0.0)) / F.greatest(size, F.lit(1.0)), F.lit(5.0))
    near = lambda f, c, d: F.coalesce(f(c).over(flow), d)
    cols = {
        "font_ratio": size / median, "is_bold": _flag(F.col("is_bold")), "is_italic": _flag(F.col("is_italic")),
        "caps_ratio": ratio(r"\p{Lu}", letters), "title_case_ratio": F.when(F.size(named) > 0, F.size(F.filter(named, lambda w: w.rlike(r"^\p{Lu}"))) / F.size(named)).otherwise(0.0),
        "n_tokens_log": F.log1p(F.size(parts)), "line_count": F.least(F.coalesce("line_count", F.lit(0)), F.lit(10)).cast("double"),
        "ends_colon": _flag(end.endswith(":")), "ends_question": _flag(end.endswith("?")), "ends_period": _flag(end.endswith(".")),
        **{k: _flag(t.rlike(p)) for k, p in CUES.items()},
        "digit_ratio": ratio(r"\p{Nd}", bare), "math_ratio": F.when(F.length(bare) > 0, (F.length(bare) - F.length(F.translate(bare, MATH, ""))) / F.length(bare)).otherwise(0.0),
        "ref_pattern": _flag(F.regexp_count(t, F.lit(REFERENCE)) >= 2),
        "rel_position": F.col("_i") / F.greatest(F.col("_n") - 1, F.lit(1)), "is_first": _flag(F.col("_i") == 0),
        "rel_y": F.coalesce("y0", F.lit(0.0)) / PAGE_HEIGHT, "indent_ratio": F.coalesce("x0", F.lit(0.0)) / PAGE_WIDTH, "gap_before_ratio": gap,
        "gap_after_ratio": F.coalesce(F.when(F.lead("page").over(flow) == F.col("page"), F.least(F.lead("gap_before").over(flow) / F.greatest(size, F.lit(1.0)), F.lit(5.0))), F.lit(0.0)),
        "prev_font_ratio": near(F.lag, size, F.lit(0.0)) / median, "next_font_ratio": near(F.lead, size, F.lit(0.0)) / median,
        "prev_is_bold": _flag(F.lag("is_bold").over(flow)), "next_is_bold": _flag(F.lead("is_bold").over(flow)),
        "prev_ends_question": _flag(F.lag(end.endswith("?")).over(flow)),
        "is_largest_font": _flag((size >= F.col("_max")) & (F.col("_max") > median * 1.05)), "is_txt": _flag(F.col("source") == "txt"),
    }
    return base.select("segment_id", "spec_id", *[F.round(c, 6).alias(k) for k, c in cols.items()], F.length(t).alias("n_chars"))


def rule_labels(segments: DataFrame) -> DataFrame:
    """(segment_id, spec_id, rule): the first layout rule that applies."""
    f = F.col
    short = (f("n_tokens_log") < 2.5) & (f("ends_period") == 0)
    rule = (
        F.when((f("is_first") == 1) & (f("font_ratio") >= 1.3), "TITLE")
        .when(short & ((f("starts_subnumber") == 1) | ((f("font_ratio") > 1.05) & (f("font_ratio") < 1.3))), "SUBHEADING")
        .when(short & ((f("font_ratio") >= 1.3) | (f("is_bold") == 1)), "HEADING")
        .when((f("ends_question") == 1) | (f("starts_qprefix") == 1), "QUESTION")
        .when(f("ref_pattern") == 1, "REFERENCE")
        .when((f("math_ratio") > 0.15) & (f("n_chars") < 120), "FORMULA")
        .when(f("def_pattern") == 1, "DEFINITION")
        .otherwise("PARAGRAPH")
    )
    return features(segments).select("segment_id", "spec_id", rule.alias("rule"))


def marked(segments: DataFrame) -> DataFrame:
    """Segments in reading order with _title, _top, _sub (what opens the document, a section, a part), _h1 and section_seq (how many sections, and
    sections and parts, have begun). The first TITLE names the document, later ones and HEADING open a section, SUBHEADING one below it."""
    flow = order()
    s = distinct_segments(segments).withColumn("label", F.coalesce("label", F.lit("PARAGRAPH")))
    first = F.sum((F.col("label") == "TITLE").cast("int")).over(flow)
    s = s.withColumn("_title", (F.col("label") == "TITLE") & (first == 1))
    s = s.withColumn("_top", ~F.col("_title") & F.col("label").isin("TITLE", "HEADING")).withColumn("_sub", F.col("label") == "SUBHEADING")
    return s.withColumn("_h1", F.sum(F.col("_top").cast("int")).over(flow)).withColumn("section_seq", F.sum((F.col("_top") | F.col("_sub")).cast("int")).over(flow))


def tree(segments: DataFrame) -> DataFrame:
    """(segment_id, spec_id, order_index, page, label, text, title, h1, h2, section_seq, section_path): the items of the section tree.

    Walking the tree equals reading order, so running counts of headings replace it. NULL labels are PARAGRAPH.
    """
    flow = order()
    under = Window.partitionBy("spec_id", "_h1").orderBy("order_index", "segment_id")
    s = marked(segments).withColumns({
        "title": F.first(F.when(F.col("_title"), F.col("text")), ignorenulls=True).over(Window.partitionBy("spec_id").orderBy("order_index", "segment_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "h1": F.last(F.when(F.col("_top"), F.col("text")), ignorenulls=True).over(flow), "h2": F.last(F.when(F.col("_sub"), F.col("text")), ignorenulls=True).over(under),
    })
    items = s.where("not _title and not _top and not _sub")
    return items.select("segment_id", "spec_id", "order_index", "page", "label", "text", F.coalesce("title", F.lit("")).alias("title"), "h1", "h2", "section_seq", F.concat_ws(" > ", "h1", "h2").alias("section_path"))


def section_pages(segments: DataFrame) -> DataFrame:
    """(spec_id, level, section_seq, heading, pages, items): sorted distinct pages of each section: of its heading, its items and, for level 1, its
    parts. Items ahead of the first section have none."""
    s = marked(segments)
    item = (~F.col("_title") & ~F.col("_top") & ~F.col("_sub")).cast("int")
    held = [F.array_join(F.array_sort(F.collect_set("page")), ",").alias("pages"), F.sum(item).alias("items")]
    head = lambda mark: F.max(F.when(F.col(mark), F.col("text"))).alias("heading")
    top = s.where("_h1 > 0").groupBy("spec_id", "_h1").agg(F.min("section_seq").alias("section_seq"), head("_top"), *held).select("spec_id", F.lit(1).alias("level"), "section_seq", "heading", "pages", "items")
    sub = s.groupBy("spec_id", "section_seq").agg(head("_sub"), *held, F.max("_sub").alias("own")).where("own")
    return top.unionByName(sub.select("spec_id", F.lit(2).alias("level"), "section_seq", "heading", "pages", "items"))


def units(segments: DataFrame) -> DataFrame:
    """(spec_id, section_path, prefix, page, order_index, pos, unit, n): formulas, references, questions and answers whole, all else by sentence."""
    whole = F.col("label").isin("FORMULA", "REFERENCE", "QUESTION", "ANSWER")
    one = F.when(whole, F.array("text")).otherwise(T.sentences(F.col("text")))
    rows = tree(segments).select("spec_id", "section_path", F.coalesce("h2", "h1").alias("head"), "page", "order_index", "segment_id", F.posexplode(one).alias("pos", "unit"))
    return rows.select("spec_id", "section_path", F.when(F.col("head").isNotNull(), F.concat("head", F.lit(": "))).otherwise("").alias("prefix"), "page", "order_index", "segment_id", "pos", "unit", F.size(T.pieces(F.col("unit"))).alias("n"))


def chunks(segments: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(spec_id, run, part, section_path, text, page_start, page_end, token_count): units of a run of one path packed greedily.

    A chunk is full when the next unit would pass `target` tokens; the next one begins with the trailing units of up to `overlap`
    tokens. The heading stands before the text unless the text begins with it. The fold is an aggregate over the units of one run,
    so its state is one section.
    """
    flow = Window.partitionBy("spec_id").orderBy("order_index", "segment_id", "pos")
    moved = (F.lag("section_path").over(flow).isNull() | (F.lag("section_path").over(flow) != F.col("section_path"))).cast("int")
    runs = units(segments).withColumn("_m", moved).withColumn("run", F.sum("_m").over(flow))
    each = runs.groupBy("spec_id", "run", "section_path", "prefix").agg(F.array_sort(F.collect_list(F.struct("order_index", "segment_id", "pos", F.struct("unit", "page", "n").alias("u")))).alias("l"))
    each = each.withColumn("l", F.transform("l", lambda x: x["u"]))
    unit = f"struct<unit:string,page:{dict(runs.dtypes)['page']},n:int>"
    start = F.struct(F.array().cast(f"array<array<{unit}>>").alias("done"), F.array().cast(f"array<{unit}>").alias("cur"), F.lit(0).alias("total"))

    def carry(cur: Column) -> Column:
        kept = F.aggregate(F.reverse(cur), F.struct(F.array().cast(f"array<{unit}>").alias("a"), F.lit(0).alias("t"), F.lit(True).alias("on")), lambda s, u: F.when(
            s["on"] & (s["t"] + u["n"] <= overlap), F.struct(F.concat(F.array(u), s["a"]).alias("a"), (s["t"] + u["n"]).alias("t"), F.lit(True).alias("on"))).otherwise(F.struct(s["a"].alias("a"), s["t"].alias("t"), F.lit(False).alias("on"))))
        return kept["a"]

    def step(s: Column, u: Column) -> Column:
        full = (F.size(s["cur"]) > 0) & (s["total"] + u["n"] > target)
        rest = carry(s["cur"])
        left = F.aggregate(rest, F.lit(0), lambda n, x: n + x["n"])  # of `overlap` tokens at most
        return F.when(full, F.struct(F.concat(s["done"], F.array(s["cur"])).alias("done"), F.concat(rest, F.array(u)).alias("cur"), (left + u["n"]).alias("total"))).otherwise(
            F.struct(s["done"].alias("done"), F.concat(s["cur"], F.array(u)).alias("cur"), (s["total"] + u["n"]).alias("total")))

    packed = F.aggregate("l", start, step, lambda s: F.concat(s["done"], F.array(s["cur"])))
    out = each.select("spec_id", "run", "section_path", "prefix", F.posexplode(packed).alias("part", "u"))
    body = F.array_join(F.transform("u", lambda u: u["unit"]), " ")
    headed = F.when((F.col("prefix") != "") & ~body.startswith(F.regexp_replace("prefix", r"[: ]+$", "")), F.concat("prefix", body)).otherwise(body)
    pages = F.transform("u", lambda u: u["page"])
    return out.select("spec_id", "run", "part", "section_path", headed.alias("text"), F.array_min(pages).alias("page_start"), F.array_max(pages).alias("page_end"), F.size(T.pieces(headed)).alias("token_count"))


def question_answers(segments: DataFrame) -> DataFrame:
    """(spec_id, question_id, answer_id, question, answer): a question and the answer right behind it in the same section."""
    inside = Window.partitionBy("spec_id", "section_seq").orderBy("order_index", "segment_id")
    t = tree(segments).select("spec_id", "segment_id", "label", "text", F.lead("label").over(inside).alias("next"), F.lead("text").over(inside).alias("answer"), F.lead("segment_id").over(inside).alias("answer_id"))
    return t.where("label = 'QUESTION' and next = 'ANSWER'").select("spec_id", F.col("segment_id").alias("question_id"), "answer_id", T.strip_cue(F.col("text")).alias("question"), T.strip_cue(F.col("answer")).alias("answer"))


def classification_summary(pairs: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """(metric, value): n, accuracy, macro and weighted precision, recall and f1 of (label, predicted) rows over a fixed list of labels."""
    r = classification_report(pairs, labels)
    n = F.sum("support")
    held = {"n": n.cast("double"), "accuracy": F.sum("hits") / n}
    for m in ("precision", "recall", "f1"):
        held |= {f"macro_{m}": F.avg(m), f"weighted_{m}": F.sum(F.col(m) * F.col("support")) / n}
    one = r.agg(*[F.round(F.coalesce(v, F.lit(0.0)), 4).alias(k) for k, v in held.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in held])))


def best_model(scores: DataFrame) -> DataFrame:
    """(model, score) with the best score of scores(ord, model, score); the first on ties."""
    return scores.agg(F.max_by(F.struct("model", "score"), F.struct("score", -F.col("ord"))).alias("x")).select("x.*")


def classification_report(pairs: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """(label, support, predicted, hits, precision, recall, f1) of (label, predicted) rows, over a fixed list of labels; 0 where undefined."""
    rows = [(x,) for x in labels or LABELS]
    fixed = pairs.sparkSession.createDataFrame(rows, "label string")
    true = pairs.groupBy("label").agg(F.count("*").alias("support"), F.count_if(F.col("label") == F.col("predicted")).alias("hits"))
    said = pairs.groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("predicted"))
    out = F.broadcast(fixed).join(true, "label", "left").join(said, "label", "left").na.fill(0)
    p = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return out.select("label", "support", "predicted", "hits", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))
