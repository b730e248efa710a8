"""Problem 9: mixing sources to target weights."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.runtime import ranked, stored

#: Vocabulary file of the public tokenizer that counts tokens; every function that counts takes it as a parameter.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's tokenizer splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Output shards (a power of two), blocks a shard, seed of all draws.
SHARDS, BLOCKS, SEED = 16, 64, 7
#: Characters that are tokenized at once, or up to the next single blank between two other characters: the pattern parts a text there, so that
#: the tokens are those of the whole text.
PIECE = 100_000
_PART = re.compile(r"(?s)(.{%d}.*?\S)(?= \S)|.+" % (PIECE - 1))


def source_key(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(source)), r"[^\p{L}\p{N}]+", "_")


def sizes(documents: DataFrame, vocabulary: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens): each document once, whole texts; NULL texts have 0 tokens, documents without id or source are left out."""
    kind = dict(documents.dtypes)["doc_id"]
    documents.sparkSession.sparkContext.addFile(vocabulary)  # the executors get it from the driver
    name = os.path.basename(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoder = tiktoken.Encoding("counting", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [sum(len(encoder.encode_ordinary(x.group())) for x in _PART.finditer(t or "")) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    read = documents.where("doc_id is not null").select("doc_id", source_key(F.col("source")).alias("source"), "text").where("source is not null and source <> ''")
    counted = read.mapInArrow(count, f"doc_id {kind}, source string, tokens long")
    return counted.groupBy("doc_id").agg(F.max(F.struct("source", "tokens")).alias("x")).select("doc_id", "x.*")


def plan(totals: dict[str, int], targets: list[tuple[str, float, int]]) -> dict[str, dict]:
    """Quota of each source in tokens: the largest mixture in which every source that has documents gives its exact share of the
    total and no document is used more often than max_repeats. Shares of sources without documents go to the others in proportion."""
    live = [(s, share, most) for s, share, most in targets if totals.get(s, 0) > 0 and share > 0 and most > 0]
    scale = sum(share for _, share, _ in live)
    total = min((most * totals[s] * scale / share for s, share, most in live), default=0.0)
    out = {}
    for s, share, most in live:
        quota = total * share / scale
        whole = min(int(quota // totals[s] + 1e-9), most)
        out[s] = {"quota": quota, "whole": whole, "rest": 0.0 if whole == most else max(0.0, quota - whole * totals[s]), "share": share, "most": most}
    return out


def tree(counts: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source (columns) in each shard (rows): a binary tree that splits the exact counts by multivariate hypergeometric
    draws, half of the blocks to either side, so that the rows sum up to counts."""
    if shards == 1:
        return counts[None, :]
    half = int(counts.sum()) // 2
    left = np.random.default_rng([seed, shards, int(counts.sum())]).multivariate_hypergeometric(counts, half, method="marginals") if counts.sum() else counts
    return np.concatenate([tree(left, shards // 2, seed * 2 + 1), tree(counts - left, shards // 2, seed * 2 + 2)])


def mixture(documents: DataFrame, targets: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(shard, position, doc_id, source, repeat, tokens): the mixed records in order.

    Every source is passed over `whole` times and the rest of its quota is drawn from one more pass; each pass has its own
    permutation (a hash of doc_id and pass). A permuted pass is cut into blocks; the splitting tree says how many blocks of a source
    each shard gets, which takes the next ones, and each shard is shuffled by itself. No document is dropped but by the quota.
    """
    size = stored(sizes(documents), "sizes")
    totals = {r.source: r.n for r in size.groupBy("source").agg(F.sum("tokens").alias("n")).join(F.broadcast(targets.select(source_key(F.col("source")).alias("source")).distinct()), "source").collect()}
    wanted = targets.where("source is not null").groupBy(source_key(F.col("source")).alias("s")).agg(F.max("target_share").alias("a"), F.max("max_repeats").alias("b")).orderBy("s").collect()
    quotas = plan(totals, [(r.s, float(r.a or 0), int(r.b or 0)) for r in wanted])
    spark = documents.sparkSession
    passes = [(s, i, q["rest"] if i == q["whole"] else float("inf")) for s, q in sorted(quotas.items()) for i in range(q["whole"] + (q["rest"] > 0))]
    rows = size.count()
    block = max(1.0, sum(q["quota"] for q in quotas.values()) / (shards * BLOCKS))
    each = F.broadcast(spark.createDataFrame(passes, "source string, repeat int, budget double"))
    used = ranked(size.join(each, "source"), ["source", "repeat"], F.xxhash64("doc_id", "repeat"), F.col("tokens"), rows).where(F.col("before") + F.col("tokens") / 2 <= F.col("budget"))
    used = stored(used.select("doc_id", "source", "repeat", "tokens", F.floor(F.col("before") / F.lit(block)).cast("int").alias("block")), "used")
    # blocks: at most shards * BLOCKS and one for each pass
    every = sorted((r.source, r.repeat, r.block) for r in used.select("source", "repeat", "block").distinct().collect())
    names = sorted({s for s, _, _ in every})
    dealt = tree(np.array([sum(s == n for s, _, _ in every) for n in names], dtype=np.int64), shards) if names else np.zeros((shards, 0), np.int64)
    at = []
    for j, n in enumerate(names):
        own = [x for x in every if x[0] == n]
        np.random.default_rng([SEED, j]).shuffle(own)
        ends = np.cumsum(dealt[:, j])
        at += [(*x, int(np.searchsorted(ends, i, side="right"))) for i, x in enumerate(map(tuple, own))]
    home = F.broadcast(spark.createDataFrame([(s, int(r), int(b), h) for s, r, b, h in at], "source string, repeat int, block int, shard int"))
    placed = used.join(home, ["source", "repeat", "block"]).drop("block")
    order = ranked(placed, ["shard"], F.xxhash64("shard", "repeat", "doc_id"), F.lit(1).cast("long"), rows)
    return order.select("shard", F.col("before").alias("position"), "doc_id", "source", "repeat", "tokens")


def report(documents: DataFrame, targets: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(source, documents, uses, most_uses, tokens, target_share, actual_share): a row for every target; 0 where a source has no document."""
    mixed = mixture(documents, targets, shards)
    by_doc = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("tokens").alias("tokens"))
    got = by_doc.groupBy("source").agg(F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"), F.sum("tokens").alias("tokens"))
    want = targets.where("source is not null").groupBy(source_key(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"))
    all_ = got.agg(F.sum("tokens").alias("all"))
    out = want.join(got, "source", "left").crossJoin(F.broadcast(all_))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("source", zero("documents"), zero("uses"), zero("most_uses"), zero("tokens"), "target_share", F.round(F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)), 6).alias("actual_share"))
