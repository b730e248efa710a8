"""Problem 5: near-duplicate records with small edits (MinHash LSH forest)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bytewords import Scan, slices
from lectern.runtime import small, stored

#: TESTDATA.md's statement of the problem: three-word sequences, more than half in both, at least 60 words.
WORDS, SHARE, LEAST_WORDS = 3, 0.5, 60
#: The longest prefix of a trie. Prefixes are shortened, and the tries grow fewer, as long as that saves more rows than it adds candidates;
#: at any length there are as many tries as find a pair at the threshold with probability TARGET, and pairs above it with a greater one.
DEPTH, TARGET = 5, 0.995
#: Words of 64 bits in a document's parity sketch.
SKETCH = 16
#: A candidate costs as much as so many rows of tries. Tries by which candidates are estimated.
WORTH, PROBED = 10, 8
#: Buckets of more members are split over several tasks.
HOT = 1000


def texts(pages: DataFrame) -> DataFrame:
    """(document_id, text): the pages of a document in order, each page once; of a repeated page the greatest text counts."""
    page = F.struct("page_number", F.coalesce("text", F.lit("")).alias("text"))
    own = pages.where("document_id is not null").groupBy("document_id").agg(F.array_sort(F.collect_list(page)).alias("p"))
    last = F.filter("p", lambda x, i: ~F.get("p", i + 1)["page_number"].eqNullSafe(x["page_number"]) | (i + 1 == F.size("p")))
    return own.select("document_id", F.array_join(F.transform(last, lambda x: x["text"]), "\n").alias("text"))


def tries(depth: int) -> int:
    """How many tries find a pair at the threshold with probability TARGET by prefixes of this length."""
    return math.ceil(math.log(1 - TARGET) / math.log(1 - SHARE**depth))


def functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(1997)
    return r.integers(1, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 62, n, dtype=np.uint64)


#: MinHash functions, and those of each trie in the order of its prefix.
FUNCTIONS = 128


def trees(depth: int) -> np.ndarray:
    r = np.random.default_rng(2005)
    return np.stack([r.permutation(FUNCTIONS)[:depth] for _ in range(tries(depth))])


def signatures(documents: DataFrame, key: str, width: int = WORDS, least: int = LEAST_WORDS) -> DataFrame:
    """(key, shingles, sig, sketch, class_a, class_b) of texts with at least `least` words: distinct word sequences of `width` words as hashes,
    MinHash values, the parity of the sequences in each of 64 SKETCH bits, and two sums that are equal for equal sets. Whole texts; NULL texts
    have no words."""
    mult, add = functions(FUNCTIONS)
    kind = dict(documents.dtypes)[key]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, 1)):
            scan = Scan(b.column(1))
            words = np.bincount(scan.row, minlength=b.num_rows)
            at = np.flatnonzero((scan.row[: len(scan.row) - width + 1] == scan.row[width - 1 :]) & (words[scan.row[: len(scan.row) - width + 1]] >= max(least, width))) if len(scan.row) >= width else np.zeros(0, np.int64)
            if not len(at):
                continue
            h = np.zeros(len(at), np.uint64)
            for j in range(width):
                h = (h ^ scan.hash[at + j].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            row = scan.row[at]
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            keep = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
            h, row = h[keep], row[keep]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            sig = np.empty((len(first), len(mult)), np.int32)
            for f in range(len(mult)):
                v = h * mult[f] + add[f]
                v ^= v >> np.uint64(32)
                sig[:, f] = (np.minimum.reduceat(v * np.uint64(0xD6E8FEB86659FD93), first) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            ends = np.append(first, len(h))
            bit = ((h * mult[1]) >> np.uint64(40)) % np.uint64(64 * SKETCH)
            odd = np.unique(np.repeat(np.arange(len(first)), np.diff(ends)) * 64 * SKETCH + bit.astype(np.int64), return_counts=True)
            odd = odd[0][odd[1] % 2 == 1]
            sketch = np.zeros(len(first) * SKETCH, np.uint64)
            np.bitwise_or.at(sketch, odd >> 6, np.left_shift(np.uint64(1), (odd & 63).astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(row[first])), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int64))),
                pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * len(mult)), pa.array(sig.ravel())),
                pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * SKETCH), pa.array(sketch.view(np.int64))),
                pa.array(np.add.reduceat(h, first).view(np.int64)), pa.array(np.add.reduceat((h >> np.uint64(7)) * mult[0] ^ h, first).view(np.int64)),
            ], names=[key, "shingles", "sig", "sketch", "class_a", "class_b"])

    return documents.select(key, "text").mapInArrow(sign, f"{key} {kind}, shingles array<long>, sig array<int>, sketch array<long>, class_a long, class_b long")


def nodes(docs: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """(d, n, node): of each document its nodes at this depth, one a trie. In the sorted trie the documents under a node stand together."""
    node = F.array(*[F.xxhash64(F.lit(t), *[F.element_at("sig", int(f) + 1) for f in own]) for t, own in enumerate(trees(depth)[:most])])
    return docs.select("d", "n", F.explode(node).alias("node"))


def depth_of(docs: DataFrame, documents: int) -> int:
    """The prefix length: from DEPTH down, as long as the shorter prefix saves more rows of tries than its candidates cost. PROBED tries over
    all documents tell how many pairs stand together under the nodes."""
    best, cost = DEPTH, None
    for depth in range(DEPTH, 0, -1):
        size = nodes(docs, depth, PROBED).groupBy("node").agg(F.count("*").alias("m")).where("m > 1")
        pairs = size.agg(F.sum(F.col("m") * (F.col("m") - 1) / 2)).first()[0] or 0
        now = tries(depth) * documents + WORTH * pairs * tries(depth) / min(PROBED, tries(depth))
        if cost is not None and now > cost:
            break
        best, cost = depth, now
    return best


def bucket_pairs(docs: DataFrame, depth: int) -> DataFrame:
    """Distinct (a, b), a < b, of documents that share the first `depth` values of the prefix in one trie at least.

    The node is the join key. A document's partner must be within the size that the threshold allows. Nodes with more than HOT members
    are split: one side by a salt, the other repeated for each.
    """
    under = nodes(docs, depth)
    size = under.groupBy("node").agg(F.count("*").alias("m")).where("m > 1")
    shared = under.join(size, "node").withColumn("parts", F.ceil(F.col("m") / HOT).cast("int"))
    left = shared.select("node", F.col("d").alias("a"), F.col("n").alias("na"), F.pmod(F.col("d"), F.col("parts").cast("long")).cast("int").alias("salt"))
    right = shared.select("node", F.col("d").alias("b"), F.col("n").alias("nb"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    near = (F.col("a") < F.col("b")) & (F.col("na") > F.col("nb") * SHARE) & (F.col("nb") > F.col("na") * SHARE)
    return left.join(right, ["node", "salt"]).where(near).select("a", "b").distinct()


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, share): candidates with the exact share of common sequences, above SHARE.

    A pair above SHARE differs in less than a share of (1 - SHARE) / (1 + SHARE) of the sizes' sum; no more bits of the parity sketches can
    differ than sequences do, so a pair whose sketches say more is left out before the sequences are read. None is lost by that.
    """
    pairs = stored(pairs, "candidates")
    n = pairs.count()
    both = lambda p, m, *columns: _sides(p, docs, m, columns)
    differ = F.aggregate(F.zip_with("a_sketch", "b_sketch", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    likely = both(pairs, n, "sketch", "n").where(differ * (1 + SHARE) < (F.col("a_n") + F.col("b_n")) * (1 - SHARE)).select("a", "b")
    likely = stored(likely, "likely")
    common = F.size(F.array_intersect("a_shingles", "b_shingles"))
    out = both(likely, likely.count(), "shingles").withColumn("both", common)
    return out.select("a", "b", (F.col("both") / (F.size("a_shingles") + F.size("b_shingles") - F.col("both"))).alias("share")).where(F.col("share") > SHARE)


def _sides(pairs: DataFrame, docs: DataFrame, n: int, columns: tuple[str, ...]) -> DataFrame:
    """Pairs (n of them) with the columns of either document, as a_ and b_."""
    ids = pairs.select(F.col("a").alias("d")).union(pairs.select("b")).distinct()
    data = docs.join(small(ids, 16, 2 * n), "d", "left_semi")
    x, y = (data.select(F.col("d").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in columns]) for k in "ab")
    return small(pairs, 16, n).join(x, "a").join(y, "b")


def similar(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(membership (document_id, d), links (a, b, share)): documents with equal sequences are one class d, links join classes."""
    every = stored(signatures(texts(pages), "document_id").withColumn("n", F.size("shingles")).withColumn("d", F.xxhash64("class_a", "class_b", "n")), "signatures")
    member = every.select("document_id", "d")
    # of documents with equal sequences one stands for all; the others are few, or a join by d
    again = stored(member.groupBy("d").agg(F.min("document_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "copies")
    docs = every.join(small(again, 80), "d", "left").where("first is null or first = document_id").select("d", "n", "sig", "sketch", "shingles")
    return member, stored(verified(bucket_pairs(docs, depth_of(docs, docs.count())), docs), "links")


def found(pages: DataFrame) -> DataFrame:
    """(document_id_a, document_id_b), a before b: all pairs of documents above the threshold, exact copies among them.

    Documents of fewer than LEAST_WORDS words, without text or with a NULL id have no pairs; rows that repeat a page count once.
    """
    member, links = similar(pages)
    linked = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = linked.union(member.groupBy("d").count().where("count > 1").select(F.col("d").alias("a"), F.col("d").alias("b")))
    x, y = member.select(F.col("document_id").alias("document_id_a"), F.col("d").alias("a")), member.select(F.col("document_id").alias("document_id_b"), F.col("d").alias("b"))
    return linked.join(x, "a").join(y, "b").where("document_id_a < document_id_b").select("document_id_a", "document_id_b")


def groups(pages: DataFrame) -> DataFrame:
    """(document_id, group_id, links): one row a document; group_id is the least document_id that is reached over links, links the number of other
    documents that are linked to it directly. A document without links is its own group."""
    from lectern.llm.splits import forest

    member, links = similar(pages)
    text = lambda c: F.col(c).cast("string")
    edges = links.select(text("a").alias("u"), text("b").alias("v"), F.lit(1).cast("long").alias("n"))
    _, root = forest(edges)
    size = member.groupBy("d").agg(F.count("*").alias("copies"))
    both = links.select("a", "b").union(links.select("b", "a"))
    near = both.join(size.withColumnRenamed("d", "b"), "b").groupBy("a").agg(F.sum("copies").alias("near")).withColumnRenamed("a", "d")
    out = member.join(size, "d").join(near, "d", "left").join(root.select(F.col("node").cast("long").alias("d"), F.col("root").cast("long").alias("r")), "d", "left")
    out = out.withColumn("g", F.coalesce("r", "d"))
    named = out.groupBy("g").agg(F.min("document_id").alias("group_id"))
    return out.join(named, "g").select("document_id", "group_id", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
