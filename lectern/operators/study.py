"""Definitions, flashcards, quizzes and their validation; key sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.segments import question_answers, tree
from lectern.runtime import folded


def document_frequency(items: DataFrame) -> DataFrame:
    """(spec_id, word, df): items of a document that hold each content word."""
    return items.select("spec_id", F.explode(F.array_distinct(T.content_words(F.col("text")))).alias("word")).groupBy("spec_id", "word").agg(F.count("*").alias("df"))


def key_sentences(items: DataFrame, most: int | None = None) -> DataFrame:
    """(segment_id, pos, sentence): of paragraphs the best sentence, two of more than 40 words (or the best `most`), in their order.

    A sentence scores the sum of ln(1 + df) of its distinct content words over the root of its number of content words.
    """
    text = items.where(F.col("label").isin("PARAGRAPH", "CONCLUSION"))
    rows = text.select("spec_id", "segment_id", F.size(T.pieces(F.col("text"))).alias("n"), F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("w", T.content_words(F.col("sentence")))
    words = rows.select("spec_id", "segment_id", "pos", F.size("w").alias("k"), F.explode(F.array_distinct("w")).alias("word"))
    score = words.join(document_frequency(items), ["spec_id", "word"]).groupBy("segment_id", "pos", "k").agg(F.sum(F.log1p("df")).alias("s"))
    scored = rows.join(score.select("segment_id", "pos", F.round(F.col("s") / F.sqrt("k"), 6).alias("score")), ["segment_id", "pos"], "left")
    own = Window.partitionBy("segment_id").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "pos")
    best = scored.withColumn("r", F.row_number().over(own)).where(F.col("r") <= (F.lit(most) if most else F.when(F.col("n") > 40, 2).otherwise(1)))
    return best.select("segment_id", "pos", "sentence")


def definitions(segments: DataFrame) -> DataFrame:
    """(spec_id, ord, term, definition, page): first definition of each term (case ignored) in reading order, from definitions, paragraphs and important points."""
    t = tree(segments).where(F.col("label").isin("DEFINITION", "PARAGRAPH", "IMPORTANT_POINT"))
    tried = F.when(F.col("label") == "DEFINITION", F.array(T.strip_cue(F.col("text")))).otherwise(T.sentences(F.col("text")))
    rows = t.select("spec_id", "order_index", "segment_id", "page", F.posexplode(tried).alias("pos", "s")).withColumn("d", T.definition(F.col("s"))).where("d is not null")
    first = Window.partitionBy("spec_id", F.lower("d.term")).orderBy("order_index", "segment_id", "pos")
    kept = rows.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    flow = Window.partitionBy("spec_id").orderBy("order_index", "segment_id", "pos")
    return kept.select("spec_id", (F.row_number().over(flow) - 1).alias("ord"), "d.term", "d.definition", "page")


def flashcards(segments: DataFrame, count: int = 10) -> DataFrame:
    """(spec_id, ord, question, answer, difficulty, source_pages): definitions, question-answer pairs, formulas, important points, in that order,
    first of each question (case ignored), the first `count` of a document."""
    one = lambda *pages: F.array_join(F.array_sort(F.array_distinct(F.array(*pages))), ",").alias("source_pages")
    d = definitions(segments)
    term = F.when(F.substring("term", 2, 1).rlike(r"^\p{Ll}"), F.lower("term")).otherwise(F.col("term"))
    cards = d.select("spec_id", F.lit(0).alias("source"), F.col("ord").cast("long").alias("at"), F.concat(F.lit("What is "), term, F.lit("?")).alias("question"), F.col("definition").alias("answer"), T.difficulty(F.col("definition")).alias("difficulty"), one("page"))
    t = tree(segments)
    place, behind = t.select(F.col("segment_id").alias("question_id"), "order_index", F.col("page").alias("p")), t.select(F.col("segment_id").alias("answer_id"), F.col("page").alias("q"))
    qa = question_answers(segments).join(place, "question_id").join(behind, "answer_id").select("spec_id", F.lit(1), F.col("order_index").cast("long"), "question", "answer", T.difficulty(F.col("answer")), one("p", "q"))
    formula = t.where((F.col("label") == "FORMULA") & F.col("text").contains("=")).withColumn("lhs", F.trim(F.substring_index("text", "=", 1))).where("lhs <> ''")
    formula = formula.select("spec_id", F.lit(2), F.col("order_index").cast("long"), F.concat(F.lit("Write the formula for "), F.col("lhs"), F.lit(".")), "text", F.lit("medium"), one("page"))
    point = t.where("label = 'IMPORTANT_POINT'").select("spec_id", F.lit(3), F.col("order_index").cast("long"), F.lit("What is an important point to remember from this topic?"), T.strip_cue(F.col("text")), F.lit("easy"), one("page"))
    every = cards.union(qa).union(formula).union(point)
    first = Window.partitionBy("spec_id", F.lower("question")).orderBy("source", "at", "answer")
    flow = Window.partitionBy("spec_id").orderBy("source", "at", "answer")
    kept = every.withColumn("_r", F.row_number().over(first)).where("_r = 1").withColumn("ord", F.row_number().over(flow)).where(F.col("ord") <= count)
    return kept.select("spec_id", "ord", "question", "answer", "difficulty", "source_pages")


def multiple_choice(segments: DataFrame) -> DataFrame:
    """(spec_id, ord, term, options, correct_index, question, explanation, difficulty, source_pages): for four definitions and more, each with the next three, in a ring, as distractors;
    the right one stands at ord mod 4."""
    d = definitions(segments)
    ring = Window.partitionBy("spec_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count("*").over(Window.partitionBy("spec_id"))
    head = F.slice(F.collect_list("definition").over(ring), 1, 3)
    own = Window.partitionBy("spec_id").orderBy("ord")
    all_ = d.withColumn("n", n).withColumn("head", head).where("n >= 4")
    nxt = lambda k: F.coalesce(F.lead("definition", k).over(own), F.element_at("head", (F.col("ord") + k - F.col("n") + 1).cast("int")))
    ready = all_.select("spec_id", "ord", "term", "definition", nxt(1).alias("a"), nxt(2).alias("b"), nxt(3).alias("c"), (F.col("ord") % 4).alias("correct_index"), F.col("page").cast("string").alias("source_pages"))
    other = F.array("a", "b", "c")
    i = F.col("correct_index").cast("int")
    options = F.concat(F.slice(other, 1, i), F.array("definition"), F.slice(other, i + 1, F.lit(3) - i))
    return ready.select("spec_id", "ord", "term", F.array_join(options, " | ").alias("options"), "correct_index", F.concat(F.lit("Which statement best describes "), F.col("term"), F.lit("?")).alias("question"),
                        F.concat(F.lit("The document defines "), F.col("term"), F.lit(" as: "), F.col("definition")).alias("explanation"), F.lit("medium").alias("difficulty"), "source_pages")


def phrases(segments: DataFrame, top: int = 12) -> DataFrame:
    """(spec_id, rank, phrase): the most frequent words of four letters and more of each document that are no function words, first seen first on
    ties; spelled as at their first place."""
    at = F.struct("order_index", "segment_id", "pos", "word")
    words = tree(segments).select("spec_id", "order_index", "segment_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "word")).where((F.length("word") > 3) & ~T.is_stop(F.lower("word")))
    counts = words.groupBy("spec_id", F.lower("word").alias("low")).agg(F.count("*").alias("n"), F.min(at).alias("first"))
    own = Window.partitionBy("spec_id").orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top).select("spec_id", "rank", F.col("first.word").alias("phrase"))


def quiz(segments: DataFrame, phrases: DataFrame, count: int = 5) -> DataFrame:
    """(spec_id, ord, question, options, correct_index, explanation, difficulty, source_pages): the first `count` questions of a document: multiple
    choice, then key sentences with a blank for the first of the document's phrases that they hold.

    phrases(spec_id, rank, phrase). A phrase is asked once; a sentence needs three other phrases that it doesn't hold as distractors; there are
    twice `count` questions at most before the cut. What is asked depends on what was, so the sentences of a document are folded in order.
    """
    choice = multiple_choice(segments).select("spec_id", "ord", "question", "options", "correct_index", "explanation", "difficulty", "source_pages")
    t = tree(segments).where("label in ('PARAGRAPH', 'CONCLUSION')")
    best = key_sentences(tree(segments), 1).join(t.select("segment_id", "spec_id", "order_index", "page"), "segment_id")
    own = phrases.groupBy("spec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda x: x["phrase"]).alias("phrases")).where(F.size("phrases") >= 4)
    held = choice.groupBy("spec_id").agg(F.count("*").alias("held"))
    rows = best.join(own, "spec_id").join(held, "spec_id", "left").select("spec_id", "order_index", "segment_id", "page", "sentence", "phrases", F.coalesce("held", F.lit(0)).alias("held"))

    def step(s: dict, r: tuple) -> list[tuple]:
        n, low = r.held + s["n"], r.sentence.lower()
        hit = next((p for p in r.phrases if p.lower() in low and p.lower() not in s["used"]), None) if n < 2 * count else None
        if hit is None:
            return []
        s["used"].add(hit.lower())
        others = [p for p in r.phrases if p.lower() != hit.lower() and p.lower() not in low][:3]
        if len(others) < 3:
            return []
        s["n"] += 1
        at = low.index(hit.lower())
        options = others[: n % 4] + [hit] + others[n % 4 :]
        return [(r.spec_id, n, f"Fill in the blank: {r.sentence[:at]}_____{r.sentence[at + len(hit):]}", " | ".join(options), n % 4, f"The original sentence reads: {r.sentence}", "hard", str(r.page))]

    kind = dict(segments.dtypes)["spec_id"]
    cloze = folded(rows, "spec_id", ["order_index", "segment_id"], lambda: {"n": 0, "used": set()}, step, f"spec_id {kind}, ord long, question string, options string, correct_index long, explanation string, difficulty string, source_pages string")
    return choice.select(*[F.col(c).cast(t).alias(c) for c, t in cloze.dtypes]).unionByName(cloze).where(F.col("ord") < count)


def quiz_problems(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(item_id, options_ok, index_ok, pages): of quiz questions, whether there are four different options (case ignored) and the index fits,
    and the source pages that exist, distinct and sorted. NULL lists count as empty, an unknown document has no page."""
    q = items.where("item_kind = 'quiz' and item_id is not null").groupBy("item_id").agg(F.max(F.struct("document_id", "options", "correct_index", "source_pages")).alias("x")).select("item_id", "x.*")
    n = pages.where("document_id is not null").groupBy("document_id").agg(F.max("page_number").alias("n"))
    opts = F.coalesce("options", F.array().cast("array<string>"))
    ok = (F.size(opts) == 4) & (F.size(F.array_distinct(F.transform(opts, F.lower))) == 4)
    kept = F.array_sort(F.array_distinct(F.filter(F.coalesce("source_pages", F.array().cast("array<int>")), lambda p: (p >= 1) & (p <= F.coalesce("n", F.lit(0))))))
    return q.join(n, "document_id", "left").select("item_id", ok.alias("options_ok"), F.coalesce(F.col("correct_index").between(0, 3), F.lit(False)).alias("index_ok"), F.array_join(kept, ",").alias("pages"))


def valid_pages(pages: Column, count: Column) -> Column:
    """The distinct pages that exist, sorted, as text."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.coalesce(pages, F.array().cast("array<int>")), lambda p: (p >= 1) & (p <= F.coalesce(count, F.lit(0)))))), ",")


def valid_cards(cards: DataFrame) -> DataFrame:
    """cards(set_id, ord, question, answer, pages, page_count) without markup, those with both texts, the first of each question (case ignored)."""
    q, a = T.clean_markup(F.col("question")), T.clean_markup(F.col("answer"))
    rows = cards.select("set_id", "ord", q.alias("question"), a.alias("answer"), valid_pages(F.col("pages"), F.col("page_count")).alias("source_pages")).where("question <> '' and answer <> ''")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("set_id", F.lower("question")).orderBy("ord"))).where("_r = 1").drop("_r")


def output_problems(outputs: DataFrame) -> DataFrame:
    """(output_id, problem): what makes a generated output unusable. outputs(output_id, task, filled: array of the names of its parts that hold
    something): notes need sections, an assignment an introduction and main_sections, an exam sheet definitions, key_concepts or important_questions."""
    lacks = lambda part: ~F.array_contains(F.coalesce("filled", F.array().cast("array<string>")), part)
    task = F.col("task")
    rules = [
        (task.isin("clean", "smart", "simple") & lacks("sections"), "sections must not be empty"), ((task == "assignment") & lacks("introduction"), "introduction must not be empty"),
        ((task == "assignment") & lacks("main_sections"), "main_sections must not be empty"), ((task == "exam") & lacks("definitions") & lacks("key_concepts") & lacks("important_questions"), "exam output is empty"),
    ]
    return outputs.select("output_id", F.explode(F.array_compact(F.array(*[F.when(bad, said) for bad, said in rules]))).alias("problem"))
