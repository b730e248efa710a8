"""Problem 8: evaluation texts leaking into training text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.bytewords import Scan, slices
from lectern.runtime import stored

RUN = 12
#: Words are near if they are this far out of their place at most; a near match has NEAR_WORDS of the 2 RUN - 1 words around an anchor near.
NEAR, NEAR_WORDS = 3, 15
#: Terms of each run of an item, rarest first, whose lists are read for near matches: one finds every exact run, further ones what was edited
#: at the rarest.
RAREST = 2
#: Items are taken in blocks of about so many characters, so that what a task holds of them is bounded.
BLOCK_CHARS = 4_000_000


def frequencies(corpus: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """How often each of the sorted terms stands in the corpus: counted in each task, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), dtype=np.int64)
        for b in (part for batch in batches for part in slices(batch, 0)):
            values = Scan(b.column(0)).hash
            at = np.minimum(np.searchsorted(terms, values), len(terms) - 1)
            total += np.bincount(at[terms[at] == values], minlength=len(terms))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms[at]), pa.array(total[at])], names=["term", "n"])

    part = corpus.select("text").mapInArrow(count, "term long, n long")
    return {r.term: r.n for r in part.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def postings(corpus: DataFrame, terms: np.ndarray, run: int = RUN) -> DataFrame:
    """(term, doc_id, pos, context): the positional index of the given terms over the whole corpus.

    context holds the hashes of the words from pos - run + 1 to pos + run - 1 (0 outside of the text): what the lists of all other
    terms hold at the adjusted offsets around pos, so that lists are intersected without a second shuffle.
    """
    side = run - 1
    kind = dict(corpus.dtypes)["doc_id"]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, 1)):
            scan = Scan(b.column(1))
            values, row = scan.hash, scan.row
            if not len(values):
                continue
            at = np.minimum(np.searchsorted(terms, values), len(terms) - 1)
            hit = np.flatnonzero(terms[at] == values)
            places = hit[:, None] + np.arange(-side, side + 1)[None, :]
            inside = (places >= 0) & (places < len(values))
            places = np.where(inside, places, 0)
            inside &= row[places] == row[hit][:, None]
            context = np.where(inside, values[places], 0)
            first = np.searchsorted(row, row[hit])
            yield pa.RecordBatch.from_arrays([
                pa.array(values[hit]), b.column(0).take(pa.array(row[hit])), pa.array((hit - first).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(hit) + 1, dtype=np.int32) * (2 * side + 1)), pa.array(context.ravel())),
            ], names=["term", "doc_id", "pos", "context"])

    return corpus.where("doc_id is not null").select("doc_id", "text").mapInArrow(post, f"term long, doc_id {kind}, pos int, context array<long>")


def anchors(items: dict[int, np.ndarray], df: dict[int, int], run: int = RUN, rarest: int = RAREST) -> list[tuple[int, int, int, list[int]]]:
    """(term, item_id, ipos, context): of every window of `run` words of an item the `rarest` terms that are rarest in the corpus, the first on ties.

    A run of an item that stands in a document holds a whole window and so its anchors: starting from the rarest terms misses none. A window
    whose rarest word was edited away in the document is found by the next.
    """
    out = []
    for item, h in items.items():
        n = np.array([df.get(int(x), 0) for x in h])
        padded = np.concatenate([np.zeros(run - 1, np.int64), h, np.zeros(run - 1, np.int64)])
        at = sorted({i + int(j) for i in range(len(h) - run + 1) for j in np.argsort(np.where(n[i : i + run] == 0, n.max() + 1, n[i : i + run]), kind="stable")[:rarest]})
        out += [(int(h[p]), item, p, padded[p : p + 2 * run - 1].tolist()) for p in at if n[p]]
    return out


def _run(side: int, doc: Column, item: Column) -> Column:
    """Length of the longest run of equal words through the middle of both contexts."""
    same = F.zip_with(doc, item, lambda a, b: (a == b) & (a != 0))
    grow = lambda flags: F.aggregate(flags, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, f: F.struct(
        (s["n"] + (s["on"] & f).cast("int")).alias("n"), (s["on"] & f).alias("on")))["n"]
    return grow(F.reverse(F.slice(same, 1, side))) + 1 + grow(F.slice(same, side + 2, side))


def _near(doc: Column, item: Column) -> Column:
    """Words of the item's context that stand in the document's context at most NEAR places away."""
    spot = F.transform(item, lambda x, i: F.when((x != 0) & F.array_contains(F.slice(doc, F.greatest(i + 1 - NEAR, F.lit(1)), 2 * NEAR + 1), x), 1).otherwise(0))
    return F.aggregate(spot, F.lit(0), lambda a, x: a + x)


def matches(corpus: DataFrame, items: DataFrame, run: int = RUN, rarest: int = RAREST) -> DataFrame:
    """(item_id, doc_id, shift, run_words, near_words): every posting of an anchor set against the item, NULL ids dropped.

    Items of fewer than `run` words have no window. Rows that repeat an id count once. The items come in blocks of BLOCK_CHARS
    characters, each against the whole corpus; for one block the terms, their counts and the anchors are of bounded size.
    """
    listed = stored(items.where("item_id is not null").groupBy("item_id").agg(F.max("text").alias("text")), "items")
    size = listed.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_CHARS))
    spark, side, out = corpus.sparkSession, run - 1, None
    for k in range(blocks):
        own = {r.item_id: Scan(pa.array([r.text], pa.string())).hash for r in listed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()}
        terms = np.unique(np.concatenate([np.zeros(0, np.int64), *own.values()]))
        found = anchors(own, frequencies(corpus, terms), run, rarest) if len(terms) else []
        keys = F.broadcast(spark.createDataFrame(found, f"term long, item_id {dict(items.dtypes)['item_id']}, ipos int, near array<long>"))
        index = stored(postings(corpus, np.unique(np.array([t for t, *_ in found], dtype=np.int64)), run), "postings") if found else None
        if index is None:
            hit = keys.select("item_id", F.lit(None).cast(dict(corpus.dtypes)["doc_id"]).alias("doc_id"), F.lit(0).alias("shift"), F.lit(0).alias("run_words"), F.lit(0).alias("near_words"))
        else:
            hit = index.join(keys, "term").select("item_id", "doc_id", (F.col("pos") - F.col("ipos")).alias("shift"), _run(side, F.col("context"), F.col("near")).alias("run_words"), _near(F.col("context"), F.col("near")).alias("near_words"))
        out = hit if out is None else out.unionByName(hit)
    return out


def found(corpus: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id) with at least RUN consecutive words of the item standing consecutively in the document."""
    return matches(corpus, items, rarest=1).where(F.col("run_words") >= RUN).select("item_id", "doc_id").distinct()


def report(corpus: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id, kind, run_words, near_words): phrase for an exact run, near for words in almost their places."""
    hit = matches(corpus, items).where((F.col("run_words") >= RUN) | (F.col("near_words") >= NEAR_WORDS))
    best = hit.groupBy("item_id", "doc_id").agg(F.max("run_words").alias("run_words"), F.max("near_words").alias("near_words"))
    return best.select("item_id", "doc_id", F.when(F.col("run_words") >= RUN, "phrase").otherwise("near").alias("kind"), "run_words", "near_words")
