"""Problem 3: reading level of each document."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.bytewords import Scan, slices, word_hash
from lectern.llm.languages import VOTES
from lectern.runtime import stored

#: Share of a document's tokens that its vocabulary must cover.
COVERED = 0.8
LEAST_WORDS = 100
#: US school grades at which secondary and university begin.
SECONDARY, UNIVERSITY = 6.0, 12.0
#: A word that makes up more than 1 / FREQUENT of all tokens is frequent; there can be at most FREQUENT of them.
FREQUENT = 200_000
#: Vocabulary sizes are steps of a ladder, so many to a doubling.
STEPS = 8
LONG = 6

_LETTERS: list[np.ndarray] = []


def page_text(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, text): each page once, words broken at line ends joined."""
    one = pages.where("document_id is not null").groupBy("document_id", "page_number").agg(F.max("text").alias("text"))
    return one.withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"(\p{L})[-¬­‐]\s*\n\s*(\p{Ll})", "$1$2"))


def letters(code: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter (beyond the basic plane none is)."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x10000)]))
    return _LETTERS[0][np.where(code < 0x10000, code, 0)]


def syllables(scan: Scan) -> np.ndarray:
    """Vowel groups of each word, one less for a silent final e, at least 1."""
    low = np.zeros(128, bool)
    low[[ord(c) for c in "aeiouyAEIOUY"]] = True
    vowel = low[np.where(scan.code < 128, scan.code, 0)]
    before = np.concatenate([[False], vowel[:-1]])
    before[scan.start] = False
    seen = np.concatenate([[0], np.cumsum(vowel & ~before)])
    n = seen[scan.end] - seen[scan.start]
    lower = np.where((scan.code >= 65) & (scan.code <= 90), scan.code + 32, scan.code)
    last, second = lower[scan.end - 1], lower[np.maximum(scan.end - 2, 0)]
    silent = (last == ord("e")) & ~((scan.end - scan.start > 1) & np.isin(second, [ord(c) for c in "ley"])) & (n > 1)
    return np.maximum(n - silent, 1)


def sentences(scan: Scan, rows: int) -> np.ndarray:
    """Stretches of each row up to . ! or ? before white space or the end that hold two letters on end."""
    code = scan.code
    if not len(code):
        return np.zeros(rows, np.int64)
    blank = np.isin(code, [9, 10, 11, 12, 13, 32])
    final = np.zeros(len(code), bool)
    final[scan.row_start[1:][np.diff(scan.row_start) > 0] - 1] = True
    stop = np.isin(code, [33, 46, 63]) & (final | np.concatenate([blank[1:], [True]]))
    stretch = np.cumsum(stop) - stop + np.cumsum(np.concatenate([[0], final[:-1]]))
    letter = letters(code)
    two = np.flatnonzero(letter[:-1] & letter[1:] & ~final[:-1])
    first = two[np.concatenate([[True], np.diff(stretch[two]) > 0])] if len(two) else two
    return np.bincount(np.searchsorted(scan.row_start, first, side="right") - 1, minlength=rows)


def vocabulary(text: DataFrame) -> DataFrame:
    """(word, total, rank) of the hashes of all words: rank by frequency over all documents; words of equal frequency share the first rank.

    The rank is 1 + the number of more frequent words, from a histogram of the counts: its distinct values are few (n distinct
    counts need n² / 2 tokens), so no task sorts the vocabulary.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = np.unique(np.concatenate([Scan(b.column(0)).hash for b in slices(batch, 0)] or [np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], names=["word", "n"])

    totals = stored(text.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("total")), "vocabulary")
    steps = totals.groupBy("total").agg(F.count("*").alias("same"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, -1)
    return totals.join(steps.select("total", (F.coalesce(F.sum("same").over(above), F.lit(0)) + 1).alias("rank")), "total").select("word", "total", "rank")


def step(rank: np.ndarray) -> np.ndarray:
    """The least step of the ladder whose vocabulary holds this rank."""
    return np.ceil(np.log2(rank) * STEPS - 1e-9).astype(np.int32)


def page_measures(text: DataFrame, word: np.ndarray, rank: np.ndarray) -> DataFrame:
    """Of each document in each batch: its measures, the tokens of each step of the ladder by the ranks of the (sorted) frequent words,
    and the other words with their counts."""
    languages = {k: np.sort(word_hash(list(v))) for k, v in VOTES.items()}
    known = step(rank)
    names = ["words", "sentences", "syllable_count", "long_words", *languages]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, 1)):
            scan = Scan(b.column(1))
            ids = b.column(0).dictionary_encode()
            doc, docs = ids.indices.to_numpy(), len(ids.dictionary)
            own = doc[scan.row]
            plain = letters(scan.code[scan.start]) & letters(scan.code[scan.end - 1]) if len(scan.start) else np.zeros(0, bool)
            per = lambda x: np.bincount(own, weights=x, minlength=docs).astype(np.int64)
            sums = [per(plain), np.bincount(doc, weights=sentences(scan, b.num_rows), minlength=docs).astype(np.int64), per(syllables(scan) * plain), per(plain & (scan.end - scan.start > LONG))]
            sums += [per(np.isin(scan.hash, v)) for v in languages.values()]
            at = np.minimum(np.searchsorted(word, scan.hash), max(0, len(word) - 1))
            often = word[at] == scan.hash if len(word) else np.zeros(len(scan.hash), bool)
            parts = [(known[at[often]].astype(np.int64) if len(word) else np.zeros(0, np.int64), own[often]), (scan.hash[~often], own[~often])]
            lists = []
            for value, of in parts:
                order = np.lexsort((value, of))
                value, of = value[order], of[order]
                new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (of[1:] != of[:-1])])) if len(value) else np.zeros(0, np.int64)
                pairs = pa.StructArray.from_arrays([pa.array(value[new]), pa.array(np.diff(np.append(new, len(value))))], ["key", "n"])
                lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(of[new], np.arange(docs + 1)).astype(np.int32)), pairs))
            yield pa.RecordBatch.from_arrays([ids.dictionary, *map(pa.array, sums), *lists], names=["document_id", *names, "steps", "others"])

    pairs = "array<struct<key: long, n: long>>"
    kind = dict(text.dtypes)["document_id"]
    return text.select("document_id", "text").mapInArrow(measure, f"document_id {kind}, " + ", ".join(f"{c} long" for c in names) + f", steps {pairs}, others {pairs}")


def solve(rows: list[list[float]], y: list[float]) -> list[float]:
    """Least squares by the normal equations (Gauss with pivoting); a column without variation gets 0."""
    n = len(y)
    m = [r[:] + [v] for r, v in zip(rows, y)]
    done: list[int] = []
    for c in range(n):
        free = [r for r in range(n) if r not in done]
        p = max(free, key=lambda r: abs(m[r][c]))
        if abs(m[p][c]) < 1e-9:
            done.append(-1 - c)
            continue
        done.append(p)
        for r in range(n):
            if r != p and m[r][c]:
                f = m[r][c] / m[p][c]
                m[r] = [a - f * b for a, b in zip(m[r], m[p])]
    return [m[p][n] / m[p][c] if p >= 0 else 0.0 for c, p in enumerate(done)]


def measured(pages: DataFrame) -> DataFrame:
    """(document_id, words, sentences, syllable_count, long_words, coverage_rank, grade_formula) of English documents of 100 words and more.

    coverage_rank is the least vocabulary on the ladder, most frequent words first, that covers COVERED of the document's tokens. The
    ranks of frequent words, of a bounded number, go to every task; each other word is in few documents and is joined by a shuffle.
    A document is English if its function-word votes for English lead; analyses.stats is not read. NULL texts count as empty.
    """
    text = stored(page_text(pages), "page-text")
    ranks = stored(vocabulary(text), "ranks")
    tokens = ranks.agg(F.sum("total")).first()[0] or 0
    top = ranks.where(F.col("total") * FREQUENT > tokens).select("word", "rank").toArrow().sort_by("word")
    part = stored(page_measures(text, top.column("word").to_numpy(), top.column("rank").to_numpy()), "measures")
    sums = part.groupBy("document_id").agg(*[F.sum(c).alias(c) for c in part.columns[1:-2]])
    english = sums.where((F.col("words") >= LEAST_WORDS) & (F.col("en") > F.greatest("de", "fr", "es"))).drop(*VOTES)
    frequent = part.select("document_id", F.inline("steps")).select("document_id", F.col("key").cast("int").alias("step"), "n")
    rare = part.select("document_id", F.inline("others")).join(ranks.select(F.col("word").alias("key"), "rank"), "key")
    rare = rare.select("document_id", F.ceil(F.log2("rank") * STEPS - 1e-9).cast("int").alias("step"), "n")
    own = Window.partitionBy("document_id")
    run = frequent.unionByName(rare).groupBy("document_id", "step").agg(F.sum("n").alias("n"))
    run = run.withColumn("seen", F.sum("n").over(own.orderBy("step"))).withColumn("all", F.sum("n").over(own))
    cover = run.where(F.col("seen") >= F.lit(COVERED) * F.col("all")).groupBy("document_id").agg(F.min("step").alias("step"))
    cover = cover.select("document_id", F.pow(F.lit(2.0), F.col("step") / STEPS).alias("coverage_rank"))
    wps, spw = F.col("words") / F.greatest("sentences", F.lit(1)), F.col("syllable_count") / F.col("words")
    return english.join(cover, "document_id").withColumn("grade_formula", 0.39 * wps + 11.8 * spw - 15.59)


def features() -> list[Column]:
    """Coverage rank and sentence complexity: words and long words a sentence, long-word share."""
    s = F.greatest(F.col("sentences"), F.lit(1))
    return [F.lit(1.0), F.ln("coverage_rank"), F.col("words") / s, F.col("long_words") / F.col("words"), F.col("long_words") / s]


def level(grade: Column) -> Column:
    return F.when(grade < SECONDARY, "elementary").when(grade <= UNIVERSITY, "secondary").when(grade.isNotNull(), "university")


def calibrated(docs: DataFrame) -> DataFrame:
    """docs with `grade`: least squares of the school-grade formula on features(), fitted by SQL sums over all documents. The formula is
    the scale only; a document's grade is what its coverage rank and sentences say on it."""
    x, k = features(), range(len(features()))
    sums = docs.agg(*[F.sum(a * b).alias(f"x{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x)], *[F.sum(a * F.col("grade_formula")).alias(f"y{i}") for i, a in enumerate(x)]).first()
    beta = solve([[float(sums[f"x{i}_{j}"] or 0) for j in k] for i in k], [float(sums[f"y{i}"] or 0) for i in k])
    beta = [b if math.isfinite(b) else 0.0 for b in beta]
    return docs.withColumn("grade", sum((b * f for b, f in zip(beta[1:], x[1:])), F.lit(beta[0])))


def levels(pages: DataFrame) -> DataFrame:
    """(document_id, coverage_rank, words_per_sentence, grade, grade_formula, level): the level is that of the calibrated grade."""
    out = calibrated(stored(measured(pages), "levels"))
    wps = F.col("words") / F.greatest("sentences", F.lit(1))
    return out.select("document_id", F.round("coverage_rank", 1).alias("coverage_rank"), F.round(wps, 4).alias("words_per_sentence"), F.round("grade", 3).alias("grade"), F.round("grade_formula", 3).alias("grade_formula"), level(F.col("grade")).alias("level"))


def found(pages: DataFrame) -> DataFrame:
    return levels(pages).select("document_id", "level")
