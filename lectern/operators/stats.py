"""Document statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

#: Characters that decide the language; words an English text needs, and their share of function words.
LANGUAGE_CHARS, LANGUAGE_WORDS, LANGUAGE_SHARE = 20_000, 20, 0.15
WORDS_A_MINUTE = 200


def once(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each record once: rows that repeat a key are the same record. Their greatest values count."""
    rest = [c for c in documents.columns if c != key]
    return documents.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*rest)).alias("x")).select(key, "x.*")


def syllables(words: Column) -> Column:
    """Syllables of all words of a text (lower case, a blank between two) by counts over the whole text, not word by word: vowel groups, one for
    each word without any, less each silent final e behind another group."""
    text = F.regexp_replace(words, r"'+(?= |$)", "")
    n = lambda p: F.regexp_count(text, F.lit(p))
    return n("[aeiouy]+") + n(r"(?<![^ ])[^aeiouy ]+(?![^ ])") - n(r"(?<![^ ])[^ ]*[aeiouy][^aeiouy ]+[^ ]*(?<![ley])e(?![^ ])")


def document_stats(documents: DataFrame) -> DataFrame:
    """(doc_id, characters, words, sentences, avg_sentence_length, reading_time_min, language, flesch_reading_ease, flesch_kincaid_grade).

    Scores are NULL for 30 words or fewer and without sentences; NULL and empty texts count 0. A row a document, computed row by row;
    only the results are made distinct.
    """
    text = F.coalesce("text", F.lit(""))
    base = documents.where("doc_id is not null").select("doc_id", F.length(text).alias("characters"), T.tokens(F.col("text")).alias("w"), F.size(T.sentences(F.col("text"))).alias("sentences"),
                                                        F.transform(T.tokens(F.left(text, F.lit(LANGUAGE_CHARS))), F.lower).alias("head"))
    lexical = F.filter("w", lambda w: ~w.rlike(r"^\d"))
    got = base.select("doc_id", "characters", "sentences", F.size("w").alias("words"), F.size(lexical).alias("lexical"), syllables(F.lower(F.array_join(lexical, " "))).alias("syllables"),
                      F.size("head").alias("head"), F.size(F.filter("head", T.is_stop)).alias("stops"))
    wps, spw = F.col("lexical") / F.col("sentences"), F.col("syllables") / F.col("lexical")
    scored = (F.col("words") > 30) & (F.col("sentences") > 0) & (F.col("lexical") > 0)
    english = (F.col("head") >= LANGUAGE_WORDS) & (F.col("stops") > LANGUAGE_SHARE * F.col("head"))
    return got.select(
        "doc_id", "characters", "words", "sentences",
        F.round(F.when(F.col("sentences") > 0, F.col("words") / F.col("sentences")).otherwise(0.0), 1).alias("avg_sentence_length"),
        F.round(F.col("words") / WORDS_A_MINUTE, 1).alias("reading_time_min"),
        F.when(english, "en").otherwise("unknown").alias("language"),
        F.round(F.when(scored, 206.835 - 1.015 * wps - 84.6 * spw), 1).alias("flesch_reading_ease"),
        F.round(F.when(scored, 0.39 * wps + 11.8 * spw - 15.59), 1).alias("flesch_kincaid_grade"),
    ).distinct()


def vocabulary(documents: DataFrame) -> DataFrame:
    """(word, syllables, n) of all words of letters, lower case, over all documents."""
    w = F.filter(F.transform(T.tokens(F.col("text")), F.lower), lambda x: ~x.rlike(r"^\d"))
    counts = once(documents.select("doc_id", "text")).select(F.explode(w).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.select("word", T.syllables(F.col("word")).alias("syllables"), "n")


def keyphrases(documents: DataFrame, top: int = 12) -> DataFrame:
    """(doc_id, rank, word, n): most frequent words of four letters and more that are no function words, first seen first on ties."""
    words = T.tokens(F.col("text"))
    rows = once(documents.select("doc_id", "text")).select("doc_id", F.posexplode(F.transform(words, F.lower)).alias("pos", "word")).where(~T.is_stop(F.col("word")) & (F.length("word") > 3))
    counts = rows.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    own = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top).select("doc_id", "rank", "word", "n")


def injections(documents: DataFrame) -> DataFrame:
    """(doc_id, pattern, n): matches of each pattern of text that addresses a model, counted; no row without any."""
    hits = F.array(*[F.struct(F.lit(i).alias("pattern"), F.regexp_count("text", F.lit("(?iu)" + p)).alias("n")) for i, p in enumerate(T.INJECTIONS)])
    return once(documents.select("doc_id", "text")).select("doc_id", F.inline(hits)).where("n > 0")


def injection_spans(documents: DataFrame, around: int = 40, most: int = 10) -> DataFrame:
    """(doc_id, n, span): the first `most` matches, pattern by pattern, with `around` characters on either side and blanks for line feeds. Only texts
    that match at all go through Python."""
    any_ = reduce(lambda a, b: a | b, [F.col("text").rlike("(?iu)" + p) for p in T.INJECTIONS])
    kind = dict(documents.dtypes)["doc_id"]

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, t in zip(pdf.doc_id, pdf.text):
                found = [t[max(0, m.start() - around) : m.end() + around].replace("\n", " ") for p in T.INJECTIONS for m in re.finditer(p, t, re.I)]
                rows += [(d, i, x) for i, x in enumerate(found[:most])]
            yield pd.DataFrame(rows, columns=["doc_id", "n", "span"])

    return once(documents.select("doc_id", "text").where(any_)).mapInPandas(spans, f"doc_id {kind}, n int, span string")


def label_counts(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"))


def extraction_summary(pages: DataFrame) -> DataFrame:
    """(document_id, pages, ocr_pages, characters): pages, sorted numbers of the scanned ones, characters of all."""
    one = pages.where("document_id is not null").groupBy("document_id", "page_number").agg(F.max(F.struct("source", "text")).alias("x")).select("document_id", "page_number", "x.*")
    return one.groupBy("document_id").agg(
        F.count("*").alias("pages"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("source") == "ocr", F.col("page_number")))), ",").alias("ocr_pages"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters"))
