"""Queries of the ten problems, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import chunking, leaks, levels, mixing, neardup, overlap, pairs, scans, spam, splits
from lectern.runtime import table as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": lambda s, d: splits.found(t(s, d, "doc_specs", "spec_id", "doc_id", "subject", "author")),
    "p1_forest": lambda s, d: splits.links(t(s, d, "doc_specs", "spec_id", "doc_id", "subject", "author")),
    "p1_splits": lambda s, d: splits.assign(t(s, d, "doc_specs", "spec_id", "doc_id", "subject", "author"), t(s, d, "split_targets")),
    "p1_shares": lambda s, d: splits.report(t(s, d, "doc_specs", "spec_id", "doc_id", "subject", "author"), t(s, d, "split_targets")),
    "p2_found": lambda s, d: overlap.found(t(s, d, "segments", "segment_id", "spec_id", "text"), t(s, d, "doc_specs", "spec_id", "split")),
    "p2_report": lambda s, d: overlap.report(t(s, d, "segments", "segment_id", "spec_id", "text", "subject"), t(s, d, "doc_specs", "spec_id", "split")),
    "p3_found": lambda s, d: levels.found(t(s, d, "document_pages", "document_id", "page_number", "text")),
    "p3_levels": lambda s, d: levels.levels(t(s, d, "document_pages", "document_id", "page_number", "text")),
    "p4_found": lambda s, d: pairs.found(t(s, d, "study_items", "item_id", "item_kind", "question", "answer", "explanation")),
    "p5_found": lambda s, d: neardup.found(t(s, d, "document_pages", "document_id", "page_number", "text")),
    "p5_groups": lambda s, d: neardup.groups(t(s, d, "document_pages", "document_id", "page_number", "text")),
    "p6_found": lambda s, d: chunking.found(t(s, d, "chunks", "id", "document_id", "order_index", "section_path", "text")),
    "p6_pieces": lambda s, d: chunking.pieces(t(s, d, "chunks", "id", "document_id", "order_index", "section_path", "text")),
    "p7_found": lambda s, d: scans.found(t(s, d, "ocr_lines", "document_id", "page", "line_no", "text"), t(s, d, "document_pages", "id", "document_id", "text", "source"), t(s, d, "uploaded_documents", "id", "title")),
    "p7_repaired": lambda s, d: scans.repaired(t(s, d, "ocr_lines", "document_id", "page", "line_no", "text"), t(s, d, "document_pages", "id", "document_id", "text", "source"), t(s, d, "uploaded_documents", "id", "title")),
    "p8_found": lambda s, d: leaks.found(t(s, d, "documents", "doc_id", "text"), t(s, d, "eval_items", "item_id", "text")),
    "p8_report": lambda s, d: leaks.report(t(s, d, "documents", "doc_id", "text"), t(s, d, "eval_items", "item_id", "text")),
    "p9_mixture": lambda s, d: mixing.mixture(t(s, d, "documents", "doc_id", "source", "text"), t(s, d, "source_targets")),
    "p9_report": lambda s, d: mixing.report(t(s, d, "documents", "doc_id", "source", "text"), t(s, d, "source_targets")),
    "p10_found": lambda s, d: spam.found(t(s, d, "documents", "doc_id", "text")),
    "p10_lines": lambda s, d: spam.scored(t(s, d, "documents", "doc_id", "text")).distinct(),
}
