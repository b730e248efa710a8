"""Queries of the core operators over whole tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import editor, layout, lines, model, notes, quality, retrieval, segments, stats, store, study
from lectern.runtime import table
from lectern.plans.fixtures import FIXTURES
from lectern.streaming import events

SEGMENT = ("segment_id", "spec_id", "order_index", "text", "page", "x0", "y0", "font_size", "is_bold", "is_italic", "line_count", "gap_before", "source", "label")
TREE = ("segment_id", "spec_id", "order_index", "text", "page", "label")
LINE = ("document_id", "page", "line_no", "text", "x0", "y0", "x1", "y1", "confidence", "height")


def _documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents", "doc_id", "text")


def _tree(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "segments", *TREE)


def _lines(s: SparkSession, d: str) -> DataFrame:
    return lines.scanned_lines(table(s, d, "ocr_lines", *LINE), table(s, d, "document_pages", "document_id", "page_number", "height"))


def _boxes(s: SparkSession, d: str) -> DataFrame:
    size = table(s, d, "document_pages", "document_id", "page_number", "width", "height").groupBy("document_id", F.col("page_number").alias("page")).agg(F.max("width").alias("page_width"), F.max("height").alias("page_height"))
    one = table(s, d, "ocr_lines", *LINE).groupBy("document_id", "page", "line_no").agg(F.max(F.struct("x0", "y0", "x1", "y1", "height")).alias("b")).select("document_id", "page", "line_no", "b.*")
    return one.join(size, ["document_id", "page"])


def _chunks(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunks", "id", "document_id", "text").where("id is not null")
    return c.groupBy("id").agg(F.max(F.struct("document_id", "text")).alias("x")).select(F.col("id").alias("chunk_id"), "x.*")


def _questions(s: SparkSession, d: str) -> DataFrame:
    """The stated query set: items whose id is divisible by 100."""
    q = table(s, d, "study_items", "item_id", "document_id", "question").where("item_id % 100 = 0")
    return q.groupBy(F.col("item_id").alias("question_id")).agg(F.max(F.struct("document_id", "question")).alias("x")).select("question_id", "x.*")


def _labelled(s: SparkSession, d: str) -> DataFrame:
    rules = segments.rule_labels(table(s, d, "segments", *SEGMENT))
    true = segments.distinct_segments(table(s, d, "segments", *TREE)).select("segment_id", "label")
    return rules.join(true, "segment_id").where("label is not null").select("label", F.col("rule").alias("predicted"))


def _hybrid(s: SparkSession, d: str) -> DataFrame:
    q, c = _questions(s, d), _chunks(s, d)
    return retrieval.retrieve(retrieval.bm25(c, q), retrieval.dense(c, q))


def _bm25_top(s: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(_chunks(s, d), _questions(s, d))


def _answers(s: SparkSession, d: str) -> DataFrame:
    top = retrieval.bm25(_chunks(s, d), _questions(s, d), top=retrieval.TOP)
    return retrieval.answers(_questions(s, d), top.join(_chunks(s, d), "chunk_id").select("question_id", "chunk_id", "rank", "text"))


def _nearest(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings", "vec_id", "embedding").where("embedding is not null").groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    return retrieval.nearest(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")))


def _uploads(s: SparkSession, d: str) -> DataFrame:
    return store.latest(table(s, d, "uploaded_documents"), "id", "updated_at")


def _listed(s: SparkSession, d: str) -> DataFrame:
    """Uploaded documents, newest row of each, with whether they have an analysis."""
    has = table(s, d, "analyses", "document_id").where("document_id is not null").distinct().withColumnRenamed("document_id", "id").withColumn("has_analysis", F.lit(True))
    return _uploads(s, d).join(has, "id", "left").select("id", "title", "status", "updated_at", F.coalesce("has_analysis", F.lit(False)).alias("has_analysis"))


def _upload_codes(s: SparkSession, d: str) -> DataFrame:
    from lectern.sources.uploads import reject_code

    return _uploads(s, d).select("id", reject_code(F.col("original_name"), F.col("size_bytes"), F.col("page_count")).alias("code"))


def _analysis_stats(s: SparkSession, d: str) -> DataFrame:
    """Stored statistics as columns, cut JSON as NULLs."""
    j = F.from_json("stats", "characters string, words string, sentences string, language string, readability struct<flesch_reading_ease:string>")
    number = lambda c: j[c].try_cast("long").alias(c)
    return table(s, d, "analyses", "id", "document_id", "stats").select(
        "id", "document_id", number("characters"), number("words"), number("sentences"), j["language"].alias("language"),
        j["readability"]["flesch_reading_ease"].try_cast("double").alias("flesch_reading_ease")).distinct()


def _split_counts(s: SparkSession, d: str) -> DataFrame:
    spec = table(s, d, "doc_specs", "spec_id", "split").where("spec_id is not null").groupBy("spec_id").agg(F.max(F.lower(F.trim("split"))).alias("split"))
    return segments.distinct_segments(table(s, d, "segments", "segment_id", "spec_id", "text")).join(spec, "spec_id", "left").groupBy(F.coalesce("split", F.lit("train")).alias("split")).agg(F.count("*").alias("segments"), F.count_distinct("spec_id").alias("documents"))


def _confusion(s: SparkSession, d: str) -> DataFrame:
    return _labelled(s, d).groupBy("label", "predicted").agg(F.count("*").alias("n"))


def _versions(s: SparkSession, d: str) -> DataFrame:
    """Event types of a user as successive contents: equal neighbours are one version."""
    e = events.timed(table(s, d, "events", "event_id", "ts", "user_id", "event_type"))
    return store.changed_versions(e, "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "version", "content_hash")


def _checkpoints(s: SparkSession, d: str) -> DataFrame:
    return store.checkpoints(events.timed(table(s, d, "events", "ts", "user_id")), "user_id", "ts", minutes=1440)


def _hashes(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "doc_specs", "spec_id", "doc_id", "fmt", "n_blocks").distinct()
    return rows.select("spec_id", store.canonical_hash("doc_id", "fmt", "n_blocks", "spec_id").alias("content_hash"))


def _rolled(s: SparkSession, d: str) -> DataFrame:
    line = table(s, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    return line.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.grouping_id().alias("level"))


def _last_before(s: SparkSession, d: str) -> DataFrame:
    """As-of: for each purchase the user's last earlier event of another type, by one window instead of a range join; -1 without any."""
    e = events.timed(table(s, d, "events", "event_id", "ts", "user_id", "event_type"))
    from pyspark.sql import Window

    own = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = e.withColumn("before", F.last(F.when(F.col("event_type") != "purchase", F.col("event_id")), ignorenulls=True).over(own))
    return seen.where("event_type = 'purchase'").select("event_id", F.coalesce("before", F.lit(-1)).alias("before"))


def _classified(s: SparkSession, d: str) -> DataFrame:
    """Confusion counts on the test split; rows of a training that is deterministic up to the last bits, so counts alone are given."""
    return model.evaluated(table(s, d, "segments", *SEGMENT), table(s, d, "doc_specs", "spec_id", "split"))


def _editable(s: SparkSession, d: str, mode: str = "clean") -> DataFrame:
    return notes.documents(_tree(s, d), mode)


def _laid_out(s: SparkSession, d: str) -> DataFrame:
    t = segments.tree(_tree(s, d)).select("spec_id", F.col("order_index").cast("long").alias("ord"), "segment_id", "text")
    from pyspark.sql import Window

    own = Window.partitionBy("spec_id").orderBy("ord", "segment_id")
    return layout.pages(t.select("spec_id", F.row_number().over(own).alias("ord"), "text"), "spec_id").groupBy("spec_id", "page").agg(F.count("*").alias("lines"), F.max("slot").alias("last_slot"), F.sum(F.length("text")).alias("characters"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "doc_stats": lambda s, d: stats.document_stats(_documents(s, d)),
    "vocabulary_syllables": lambda s, d: stats.vocabulary(_documents(s, d)),
    "keyphrases": lambda s, d: stats.keyphrases(_documents(s, d)),
    "injection_flags": lambda s, d: stats.injections(_documents(s, d)),
    "lang_counts": lambda s, d: stats.label_counts(stats.once(table(s, d, "documents", "doc_id", "lang")), "lang"),
    "extraction_summary": lambda s, d: stats.extraction_summary(table(s, d, "document_pages", "document_id", "page_number", "source", "text")),
    "analysis_stats": _analysis_stats,
    "text_lines": lambda s, d: lines.text_lines(stats.once(_documents(s, d))),
    "furniture_removed": lambda s, d: lines.without_furniture(_lines(s, d)).select("document_id", "page", "line_no", "text"),
    "lead_gaps": lambda s, d: lines.leading(_lines(s, d)),
    "merged_segments": lambda s, d: lines.merged(lines.without_furniture(_lines(s, d))),
    "segment_features": lambda s, d: segments.features(table(s, d, "segments", *SEGMENT)),
    "rule_labels": lambda s, d: segments.rule_labels(table(s, d, "segments", *SEGMENT)),
    "label_counts": lambda s, d: stats.label_counts(segments.distinct_segments(table(s, d, "segments", "segment_id", "spec_id", "text", "label")), "label"),
    "classification_report": lambda s, d: segments.classification_report(_labelled(s, d)),
    "classification_summary": lambda s, d: segments.classification_summary(_labelled(s, d)),
    "confusion_matrix": _confusion,
    "split_counts": _split_counts,
    "section_tree": lambda s, d: segments.tree(_tree(s, d)).drop("text"),
    "section_pages": lambda s, d: segments.section_pages(_tree(s, d)),
    "chunk_tree": lambda s, d: segments.chunks(_tree(s, d)),
    "question_answers": lambda s, d: segments.question_answers(_tree(s, d)),
    "doc_freq": lambda s, d: study.document_frequency(segments.tree(_tree(s, d))),
    "key_sentences": lambda s, d: study.key_sentences(segments.tree(_tree(s, d))),
    "definitions": lambda s, d: study.definitions(_tree(s, d)),
    "flashcards": lambda s, d: study.flashcards(_tree(s, d)),
    "quiz_choices": lambda s, d: study.multiple_choice(_tree(s, d)),
    "quiz": lambda s, d: study.quiz(_tree(s, d), study.phrases(_tree(s, d))),
    "document_phrases": lambda s, d: study.phrases(_tree(s, d)),
    "quiz_problems": lambda s, d: study.quiz_problems(table(s, d, "study_items", "item_id", "item_kind", "document_id", "options", "correct_index", "source_pages"), table(s, d, "document_pages", "document_id", "page_number")),
    "notes_clean": lambda s, d: notes.notes(_tree(s, d), "clean"),
    "notes_smart": lambda s, d: notes.notes(_tree(s, d), "smart"),
    "notes_simple": lambda s, d: notes.notes(_tree(s, d), "simple"),
    "exam_sheet": lambda s, d: notes.exam(_tree(s, d)),
    "assignment_objectives": lambda s, d: notes.objectives(_tree(s, d)),
    "outlines": lambda s, d: notes.outline(_tree(s, d)).select("spec_id", F.length("text").alias("characters"), F.sha2("text", 256).alias("digest")),
    "outline_parts": lambda s, d: notes.outline_parts(notes.outline(_tree(s, d)), 2000).select("spec_id", "part", F.length("text").alias("characters")),
    "classified": _classified,
    "editor_documents": lambda s, d: editor.checked(_editable(s, d), "spec_id", "content").select("spec_id", "problem", "content_hash"),
    "editor_blocks": lambda s, d: editor.block_rows(_editable(s, d), "spec_id", "content"),
    "editor_counts": lambda s, d: editor.counts(_editable(s, d), "spec_id", "content"),
    "editor_kept": lambda s, d: editor.editor_form(_editable(s, d, "smart"), "spec_id", "content").select("spec_id", "kept"),
    "assignment_documents": lambda s, d: editor.checked(_editable(s, d, "assignment"), "spec_id", "content").select("spec_id", "problem", "content_hash"),
    "exam_documents": lambda s, d: editor.checked(_editable(s, d, "exam"), "spec_id", "content").select("spec_id", "problem", "content_hash"),
    "preserved_blocks": lambda s, d: editor.block_rows(_editable(s, d, "preserve"), "spec_id", "content").select("spec_id", "ord", "type", "level", "align", "marker", "text"),
    "assignment_parts": lambda s, d: notes.assignment(_tree(s, d)),
    "page_layout": _laid_out,
    "bm25_topk": _bm25_top,
    "dense_topk": _nearest,
    "hybrid_retrieve": _hybrid,
    "extractive_answers": _answers,
    "list_documents": _listed,
    "latest_documents": lambda s, d: _uploads(s, d).select("id", "title", "status", "page_count", "updated_at"),
    "upload_codes": _upload_codes,
    "orphan_chunks": lambda s, d: store.cascade(_uploads(s, d).where("status <> 'failed'"), _chunks(s, d), "document_id", "id").select("chunk_id", "document_id"),
    "version_dedup": _versions,
    "checkpoint_throttle": _checkpoints,
    "canonical_hash": _hashes,
    "line_collisions": lambda s, d: quality.collisions(_boxes(s, d)),
    "page_metrics": lambda s, d: quality.page_metrics(_boxes(s, d)),
    "lonely_headings": lambda s, d: quality.lonely_lines(segments.distinct_segments(_tree(s, d))),
    "rate_sliding": lambda s, d: events.sliding_count(table(s, d, "events", "event_id", "ts", "user_id"), 86_400).select("event_id", "user_id", "hits"),
    "rate_limited": lambda s, d: events.rate_limited(table(s, d, "events", "event_id", "ts", "user_id"), 3, 86_400),
    "autosave_bursts": lambda s, d: events.sessions(table(s, d, "events", "ts", "user_id"), "6 hours"),
    "autosaves": lambda s, d: events.autosaves(table(s, d, "events", "ts", "user_id"), 21_600, 86_400),
    "tumbling_counts": lambda s, d: events.tumbling(table(s, d, "events", "ts", "event_type", "value"), "1 day"),
    "rollup_lines": _rolled,
    "last_before": _last_before,
} | {k: (lambda s, d, f=f: f.apply(s)) for k, f in FIXTURES.items()}
