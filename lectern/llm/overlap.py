"""Problem 2: same or near-same records across splits (edit-distance segment join)."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.bytewords import Scan, slices
from lectern.llm.splits import subject_key
from lectern.runtime import small, stored, written

#: TESTDATA.md's statement of the problem: words, and the share of the longer text's words that may be edited (1 / EDITS).
LEAST_WORDS, EDITS = 15, 5
#: Longest piece of an evaluation text, in words; texts of more than CUT words are cut stretch by stretch, each with its share of the pieces.
PIECE, CUT = 8, 512
#: Buckets of the counts of words, word pairs and runs of three words in the training side; they only steer where texts are cut.
BUCKETS, SUMS = (1 << 16, 1 << 20, 1 << 22), 4
#: Filter of all pieces: bits an entry, bits set for each, bits of a part at most, bits of the parts that a task holds at once.
BITS_AN_ENTRY, PROBES, PART_BITS, HELD_BITS = 20, 3, 1 << 25, 1 << 28
#: Words of training texts that a task hashes before it goes through the parts of a filter that it can't hold at once.
CHUNK = 1 << 21
#: A text of more copies is one text until pairs are known. A piece of more evaluation texts, and a class of more copies, is spread over tasks.
COPIES, HOT = 4, 1000

_M = np.uint64(0x9E3779B97F4A7C15)


def role(split: Column) -> Column:
    """train, or the name of the evaluation split; NULL for anything else."""
    s = F.lower(F.trim(split))
    return F.when(s.isin("train", "val", "test"), s)


def segment_words(segments: DataFrame, specs: DataFrame) -> DataFrame:
    """(segment_id, side, w, a, b): word hashes of the segments of train (0), val (1) and test (2) with LEAST_WORDS words and more.

    a, b: the same for equal word sequences. A row that repeats a segment_id stays until pairs are made distinct. NULL texts, ids and splits
    are left out.
    """
    split = specs.where("spec_id is not null").groupBy("spec_id").agg(F.max(role(F.col("split"))).alias("side")).where("side is not null")
    split = split.select("spec_id", F.when(F.col("side") == "train", 0).when(F.col("side") == "val", 1).otherwise(2).alias("side"))
    kind = dict(segments.dtypes)["segment_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, 2)):
            s = Scan(b.column(2))
            n = np.bincount(s.row, minlength=b.num_rows)
            keep = n >= LEAST_WORDS
            w = s.hash[keep[s.row]]
            rows = np.flatnonzero(keep)
            if not len(rows):
                continue
            first = np.cumsum(n[rows]) - n[rows]
            place = (np.arange(len(w)) - np.repeat(first, n[rows])).astype(np.uint64)
            mixed = (w.view(np.uint64) ^ (place * np.uint64(0xC2B2AE3D27D4EB4F))) * _M
            mixed ^= mixed >> np.uint64(31)
            codes = [np.add.reduceat(mixed * f ^ (mixed >> np.uint64(17)), first).view(np.int64) for f in (_M, np.uint64(0xD6E8FEB86659FD93))]
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)),
                pa.ListArray.from_arrays(pa.array(np.append(first, len(w)).astype(np.int32)), pa.array(w)), *map(pa.array, codes),
            ], names=["segment_id", "side", "w", "a", "b"])

    read = segments.where("segment_id is not null and text is not null").select("segment_id", "spec_id", "text")
    joined = read.join(small(split, 24), "spec_id").select("segment_id", "side", "text")
    return joined.mapInArrow(scan, f"segment_id {kind}, side int, w array<long>, a long, b long")


def copied(words: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(words with one segment for each text of more than COPIES copies on one side, (rep, segment_id, copies) of these texts or None)."""
    held = (F.col("side") > 0).alias("held")
    many = words.groupBy(held, "a", "b").agg(F.min("segment_id").alias("rep"), F.count("*").alias("copies")).where(F.col("copies") > COPIES)
    many = stored(many, "copies")
    n = many.count()
    if not n:
        return words, None
    joined = words.withColumn("held", F.col("side") > 0).join(small(many, 40, n), ["held", "a", "b"], "left")
    member = joined.where("rep is not null").select("rep", "segment_id", "copies").distinct()
    return joined.where("rep is null or rep = segment_id").select(*words.columns), stored(member, "members")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    o = column.offsets.to_numpy()
    return column.values.to_numpy()[o[0] : o[-1]].view(np.uint64), np.diff(o)


def _runs(w: np.ndarray, l: int) -> np.ndarray:
    """Bucket of each run of l words (l = 1, 2, 3), along the last axis."""
    h = w
    for j in range(1, l):
        h = (h[..., :-1] * _M) ^ w[..., j:]
    return (((h * _M) if l > 1 else h) >> np.uint64(20)) % np.uint64(BUCKETS[l - 1])


def counts(train: DataFrame) -> list[np.ndarray]:
    """How often words, pairs and runs of three stand in the training side, by bucket of their hash: tables of fixed size whatever the data.

    Each task counts its texts, SUMS tasks add the packed tables up, the driver adds theirs.
    """
    base = np.cumsum((0, *BUCKETS))

    def packed(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["total"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(base[-1], np.int64)
        for b in batches:
            w, n = _flat(b.column(0))
            row = np.repeat(np.arange(len(n)), n)
            for l in (1, 2, 3):
                at = _runs(w, l)[row[: max(0, len(w) - l + 1)] == row[l - 1 :]].astype(np.int64)
                np.add.at(total, at + base[l - 1], 1)
        yield packed(total.astype(np.uint32))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(base[-1], np.float32)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(zlib.decompress(x.as_buffer()), np.uint32)
        yield packed(total)

    total = np.zeros(base[-1], np.float32)
    for x in train.select("w").mapInArrow(count, "total binary").repartition(SUMS).mapInArrow(add, "total binary").toLocalIterator():
        total += np.frombuffer(zlib.decompress(x.total), np.float32)
    return np.split(total, base[1:-1])


def word_bits(w: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    """Two columns of 64 bits: one for the hash modulo 128 of each word of a text. An edit changes two bits at most."""
    spot = (w >> np.uint64(40)) & np.uint64(127)
    one, first = np.left_shift(np.uint64(1), spot & np.uint64(63)), np.cumsum(n) - n
    return [pa.array(np.bitwise_or.reduceat(np.where(spot >> np.uint64(6) == i, one, np.uint64(0)), first).view(np.int64)) for i in (0, 1)]


def edits_of(n: Column) -> Column:
    return F.floor(F.floor(n * EDITS / (EDITS - 1)) / EDITS)


def edits(n: int) -> int:
    """Most edits that a text of n words and any partner may be apart: the partner has n * EDITS / (EDITS - 1) words at most."""
    return (n * EDITS // (EDITS - 1)) // EDITS


def cuts(w: np.ndarray, seen: list[np.ndarray]) -> np.ndarray:
    """Starts of the edits + 1 pieces of texts of equal length (a row each), with the end: of all ways to cut, the one whose pieces are
    expected least often at its places in the training side, by a chain of runs of three words. Any text within the edits leaves one piece whole.

    Texts of more than CUT words are cut stretch by stretch, so that the tables are of bounded size; the number of pieces is the same.
    """
    n = w.shape[1]
    pieces, parts = edits(n) + 1, math.ceil(n / CUT)
    ends, share = [n * i // parts for i in range(parts + 1)], [pieces * i // parts for i in range(parts + 1)]
    out = [_cuts(w[:, a:b], q - p, p, pieces, seen)[:, :-1] + a for a, b, p, q in zip(ends, ends[1:], share, share[1:])]
    return np.concatenate([*out, np.full((len(w), 1), n)], axis=1)


def _cuts(w: np.ndarray, pieces: int, before: int, all_: int, seen: list[np.ndarray]) -> np.ndarray:
    rows, n = w.shape
    most = max(PIECE, math.ceil(n / pieces))
    one, two, three = (np.log(seen[l - 1][_runs(w, l)] + 0.1) for l in (1, 2, 3))
    # a further word makes a run so much rarer as it makes its last three words rarer than the two before it
    sums = np.concatenate([np.zeros((rows, 2)), np.cumsum(np.minimum(three - two[:, :-1], 0.0), axis=1)], axis=1)
    # cost of a piece of length l from i: the expected number of times it stands in the training side
    cost = [None, np.exp(one), np.exp(two)] + [np.exp(two[:, : n - l + 1] + sums[:, l - 1 :] - sums[:, 1 : n - l + 2]) for l in range(3, most + 1)]
    best = np.full((rows, n + 1), np.inf)
    best[:, 0] = 0
    back = np.zeros((pieces, rows, n + 1), np.int8)
    for p in range(pieces):
        places = 2 * min(p + before, all_ - 1 - p - before) + 1
        now = np.full((rows, n + 1), np.inf)
        for l in range(1, most + 1):
            new = best[:, : n - l + 1] + cost[l] * places
            better = new < now[:, l:]
            now[:, l:] = np.where(better, new, now[:, l:])
            back[p][:, l:] = np.where(better, l, back[p][:, l:])
        best = now
    out = np.empty((rows, pieces + 1), np.int64)
    out[:, pieces] = n
    at = np.full(rows, n)
    for p in range(pieces - 1, -1, -1):
        at = at - back[p][np.arange(rows), at]
        out[:, p] = at
    return out


def _hashes(w: np.ndarray, most: int) -> list[np.ndarray]:
    """Hash of the piece of length l that starts at each place, for l = 1 .. most."""
    h, out = np.zeros(len(w), np.uint64), []
    for l in range(1, most + 1):
        if l > len(w):
            break
        h = (h[: len(w) - l + 1] ^ w[l - 1 :]) * _M
        h ^= h >> np.uint64(31)
        out.append(h)
    return out


def eval_pieces(held: DataFrame, seen: list[np.ndarray]) -> DataFrame:
    """(h, eval_id, spot, i, low, high): the pieces of the evaluation texts; spot is the text's number of words times 2^32 and the place of piece i."""
    kind = dict(held.dtypes)["segment_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, n = _flat(b.column(1))
            if not len(flat):
                continue
            first, bits = np.cumsum(n) - n, word_bits(flat, n)
            for size in np.unique(n):
                every = np.flatnonzero(n == size)
                for part in np.array_split(every, min(len(every), math.ceil(len(every) * size / 50_000))):
                    w = flat[first[part][:, None] + np.arange(size)[None, :]]
                    at = cuts(w, seen)
                    pieces = at.shape[1] - 1
                    start, length = at[:, :-1].ravel(), np.diff(at, axis=1).ravel()
                    row = np.repeat(np.arange(len(part)), pieces)
                    h = np.zeros(len(start), np.uint64)
                    for j in range(int(length.max())):
                        on = np.flatnonzero(length > j)
                        x = (h[on] ^ w[row[on], start[on] + j]) * _M
                        h[on] = x ^ (x >> np.uint64(31))
                    at = b.column(0).take(pa.array(part[row]))
                    spot, index = np.int64(size) << 32 | start, np.tile(np.arange(pieces, dtype=np.int32), len(part))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(h.view(np.int64)), at, pa.array(spot), pa.array(index), *[x.take(pa.array(part[row])) for x in bits],
                    ], names=["h", "eval_id", "spot", "i", "low", "high"])

    return held.select("segment_id", "w").mapInArrow(cut, f"h long, eval_id {kind}, spot long, i int, low long, high long")


def _bits(h: np.ndarray, place: np.ndarray, right: bool, bits: int) -> Iterator[np.ndarray]:
    """The PROBES bits, in the filter part of its hash, of a piece at a place that is counted from the left or the right end of the text."""
    key = (h ^ (place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(right))) * _M
    for _ in range(PROBES):
        key ^= key >> np.uint64(29)
        key = key * np.uint64(0xD6E8FEB86659FD93)
        yield ((key >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)


def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their counts of several such lists."""
    value, at = np.unique(np.concatenate([v for v, _ in held]), return_inverse=True)
    return value, np.bincount(at, weights=np.concatenate([n for _, n in held]), minlength=len(value)).astype(np.int64)


class Filter:
    """All pieces at all places where a training text may hold them, in parts by ranges of the hash, each a row of a table in the shared folder.

    If piece i (from 0) of the edits + 1 pieces is the first with no more than i edits up to its end, it stands whole in the partner, the
    pieces before it have i edits, those behind it the rest at most. So its place moves by i at most from the left end of the text and by
    edits - i from the right end; the nearer end is entered.
    """

    def __init__(self, pieces: DataFrame, held_bits: int = HELD_BITS):
        k, i = edits_of(F.shiftright("spot", 32)), F.col("i")
        entries = pieces.agg(F.sum(2 * F.least(i, k - i) + 1)).first()[0] or 1
        self.parts = 1 << max(2, math.ceil(math.log2(entries * BITS_AN_ENTRY / PART_BITS)))
        self.bits = 1 << max(10, math.ceil(math.log2(entries * BITS_AN_ENTRY / self.parts)))
        self.at_once = max(1, held_bits // self.bits)
        parts, bits = self.parts, self.bits

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: dict[int, np.ndarray] = {}
            held: dict[int, list] = {}
            for b in batches:
                h, spot, index = (b.column(c).to_numpy() for c in range(3))
                every = h.view(np.uint64) >> np.uint64(64 - int(math.log2(parts)))
                for part in np.unique(every):
                    on = every == part
                    bit = own.setdefault(int(part), np.zeros(bits, bool))
                    x, n, pos, left = h[on].view(np.uint64), spot[on] >> 32, spot[on] & 0xFFFFFFFF, index[on].astype(np.int64)
                    held.setdefault(int(part), []).append(np.unique(x, return_counts=True))
                    if len(held[int(part)]) > 63:
                        held[int(part)] = [merged(held[int(part)])]
                    rest = (n * EDITS // (EDITS - 1)) // EDITS - left
                    for right in (False, True):
                        near = np.flatnonzero((left > rest) == right)
                        reach, place = np.minimum(left, rest)[near], np.where(right, n - pos, pos)[near]
                        for d in range(-int(reach.max(initial=0)), int(reach.max(initial=0)) + 1):
                            go = np.flatnonzero((abs(d) <= reach) & (place + d >= 0))
                            for s in _bits(x[near][go], place[go] + d, right, bits):
                                bit[s] = True
            for part, bit in own.items():
                piece, n = merged(held[part])
                hot = [{"h": int(x), "spread": -(-int(c) // HOT)} for x, c in zip(piece[n > HOT].view(np.int64), n[n > HOT])]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bit, bitorder="little").tobytes()], pa.binary()), pa.array([hot], hot_type)], names=["part", "bit", "hot"])

        hot_type = pa.list_(pa.struct([("h", pa.int64()), ("spread", pa.int32())]))
        part = F.shiftrightunsigned("h", 64 - int(math.log2(parts)))
        marked = pieces.select("h", "spot", "i").repartition(parts, part).mapInArrow(mark, "part int, bit binary, hot array<struct<h: long, spread: int>>")
        self.path = written(marked, "filter")

    def hot(self, spark: SparkSession) -> DataFrame:
        """(h, spread): pieces of more than HOT evaluation texts, and over how many tasks they are spread."""
        return spark.read.parquet(self.path).select(F.inline("hot"))

    def load(self, low: int) -> np.ndarray:
        """The bytes of the parts from `low` on that are held at once."""
        out = np.zeros((self.at_once, self.bits >> 3), np.uint8)
        for part, bit in zip(*pq.read_table(self.path, columns=["part", "bit"], filters=[("part", ">=", low), ("part", "<", low + self.at_once)]).columns):
            out[part.as_py() - low] = np.frombuffer(bit.as_buffer(), np.uint8)
        return out.ravel()


def train_pieces(train: DataFrame, own: Filter, most: int = PIECE) -> DataFrame:
    """(h, train_id, tspot, tlow, thigh): the stretches of the training texts that may be a piece of an evaluation text, in one pass over the texts.

    tspot is the text's number of words times 2^32 and the stretch's place. A task that can't hold the filter hashes CHUNK words, then goes
    through the parts.
    """
    kind = dict(train.dtypes)["segment_id"]
    rounds, shift = range(0, own.parts, own.at_once), np.uint64(64 - int(math.log2(own.parts)))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, words = [], 0
        for b in batches:
            held.append(b)
            words += len(_flat(b.column(1))[0])
            if len(rounds) == 1 or words >= CHUNK:
                yield pa.Table.from_batches(held).combine_chunks()
                held, words = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = own.load(0) if len(rounds) == 1 else None
        for b in (t.to_batches()[0] for t in chunks(batches) if t.num_rows):
            w, n = _flat(b.column(1))
            if not len(w):
                continue
            row, bits = np.repeat(np.arange(len(n)), n), word_bits(w, n)
            place = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
            every = [(l, h, np.flatnonzero(row[: len(h)] == row[l - 1 :])) for l, h in enumerate(_hashes(w, most), 1)]
            for low in rounds:
                now = own.load(low) if bit is None else bit
                for _, h, inside in every:
                    at = inside if bit is not None else inside[(h[inside] >> shift) // np.uint64(own.at_once) == low // own.at_once]
                    base = ((h[at] >> shift).astype(np.int64) - low) * own.bits
                    hit = np.zeros(len(at), bool)
                    for right in (False, True):
                        on = np.arange(len(at))
                        spots = _bits(h[at], n[row[at]] - place[at] if right else place[at], right, own.bits)
                        for s in spots:
                            s = s[on] + base[on]
                            on = on[(now[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1]
                        hit[on] = True
                    at = at[hit]
                    if len(at):
                        own_row = pa.array(row[at])
                        yield pa.RecordBatch.from_arrays([
                            pa.array(h[at].view(np.int64)), b.column(0).take(own_row), pa.array(n[row[at]].astype(np.int64) << 32 | place[at]), *[x.take(own_row) for x in bits],
                        ], names=["h", "train_id", "tspot", "tlow", "thigh"])

    return train.select("segment_id", "w").mapInArrow(probe, f"h long, train_id {kind}, tspot long, tlow long, thigh long")


def candidates(words: DataFrame, held_bits: int = HELD_BITS) -> DataFrame:
    """Distinct (eval_id, train_id) that share a piece at places that the edits allow, with fitting lengths and words.

    The evaluation side of a piece of more than HOT evaluation texts is spread over tasks, the training side repeated for each.
    """
    held, train = words.where("side > 0"), words.where("side = 0")
    pieces = stored(eval_pieces(held, counts(train)), "pieces")
    own = Filter(pieces, held_bits)
    hot = small(own.hot(words.sparkSession), 16)
    one = F.coalesce("spread", F.lit(1))
    salted = lambda salt: F.when(salt == 0, F.col("h")).otherwise(F.xxhash64("h", salt)).alias("h")
    left = pieces.join(hot, "h", "left").select("*", F.pmod(F.xxhash64("eval_id"), one).cast("int").alias("salt")).select(salted(F.col("salt")), *[c for c in pieces.columns if c != "h"])
    right = train_pieces(train, own).join(hot, "h", "left").select("*", F.explode(F.sequence(F.lit(0), one - 1)).alias("salt")).select(salted(F.col("salt")), "train_id", "tspot", "tlow", "thigh")
    n, m, low = F.shiftright("spot", 32), F.shiftright("tspot", 32), F.lit(0xFFFFFFFF).cast("long")
    pos, tpos = F.col("spot").bitwiseAND(low), F.col("tspot").bitwiseAND(low)
    k, i = F.floor(F.greatest(n, m) / EDITS), F.col("i")
    fits = (F.abs(n - m) <= k) & (F.abs(pos - tpos) <= i) & (F.abs((n - pos) - (m - tpos)) <= k - i)
    fits &= F.bit_count(F.col("low").bitwiseXOR(F.col("tlow"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("thigh"))) <= 2 * k
    return left.join(right, "h").where(fits).select("eval_id", "train_id").distinct()


def distances(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Edit distance of each pair of word lists up to the number of edits that the threshold allows; a large number beyond it.

    Equal beginnings and ends are left out. The band starts narrow and is widened for the pairs that need it, so that long texts that are nearly
    equal cost little.
    """
    out = np.full(len(a), 1 << 20)
    limit = np.array([max(len(x), len(y)) // EDITS for x, y in zip(a, b)], dtype=np.int64)
    bare = [_bare(x, y) for x, y in zip(a, b)]
    open_, band = np.flatnonzero([abs(len(x) - len(y)) <= k for (x, y), k in zip(bare, limit)]), 16
    while len(open_):
        for key in {(len(bare[i][0]), len(bare[i][1]), int(min(limit[i], band))) for i in open_}:
            at = np.array([i for i in open_ if (len(bare[i][0]), len(bare[i][1]), min(limit[i], band)) == key])
            if abs(key[0] - key[1]) <= key[2]:
                d = _banded(np.stack([bare[i][0] for i in at]), np.stack([bare[i][1] for i in at]), key[2])
                out[at] = np.where(d <= key[2], d, out[at])
        open_ = open_[(out[open_] > limit[open_]) & (limit[open_] > band)]
        band *= 4
    return out


def _bare(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both lists without what they begin and end with alike."""
    for _ in range(2):
        n = min(len(x), len(y))
        other = np.flatnonzero(x[:n] != y[:n])
        k = int(other[0]) if len(other) else n
        x, y = x[k:][::-1], y[k:][::-1]
    return x, y


def _banded(x: np.ndarray, y: np.ndarray, band: int) -> np.ndarray:
    """Edit distances of rows of equal length (x: rows x n, y: rows x m), right where they are at most `band`."""
    (rows, size), other = x.shape, y.shape[1]
    width = 2 * band + 1
    j = np.arange(-band, band + 1)  # offset of the other text's place
    row = np.where(j >= 0, j, 1 << 20)[None, :].repeat(rows, 0).astype(np.int64)
    row = np.where(j <= other, row, 1 << 20)
    for i in range(1, size + 1):
        place = i + j
        ok = (place >= 1) & (place <= other)
        same = np.zeros((rows, width), bool)
        same[:, ok] = x[:, i - 1 : i] == y[:, place[ok] - 1]
        step = np.minimum(row + ~same, np.concatenate([row[:, 1:] + 1, np.full((rows, 1), 1 << 20)], axis=1))
        step = np.where(ok[None, :], step, np.where(place == 0, i, 1 << 20)[None, :])
        row = np.minimum.accumulate(step - j[None, :], axis=1) + j[None, :]
        row = np.where((place >= 0) & (place <= other), row, 1 << 20)
    return row[:, other - size + band]


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(eval_id, train_id, edits, longer) of the candidates within the threshold, by banded dynamic programming over whole texts."""
    n = pairs.count()
    ids = pairs.select(F.col("eval_id").alias("segment_id")).union(pairs.select("train_id")).distinct()
    few = stored(words.join(small(ids, 16, 2 * n), "segment_id", "left_semi").groupBy("segment_id").agg(F.max("w").alias("w")), "texts")
    x, y = few.select(F.col("segment_id").alias("eval_id"), F.col("w").alias("x")), few.select(F.col("segment_id").alias("train_id"), F.col("w").alias("y"))
    kind = dict(words.dtypes)["segment_id"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (p, np_), (q, nq) = _flat(b.column(2)), _flat(b.column(3))
            a, c = np.split(p, np.cumsum(np_)[:-1]), np.split(q, np.cumsum(nq)[:-1])
            d, longer = distances(a, c), np.maximum(np_, nq)
            at = np.flatnonzero(d * EDITS <= longer)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(d[at].astype(np.int32)), pa.array(longer[at].astype(np.int32))], names=["eval_id", "train_id", "edits", "longer"])

    return small(pairs, 16, n).join(x, "eval_id").join(y, "train_id").select("eval_id", "train_id", "x", "y").mapInArrow(check, f"eval_id {kind}, train_id {kind}, edits int, longer int")


def overlaps(segments: DataFrame, specs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """((eval_id, train_id, edits, longer): all pairs of an evaluation and a training text within the threshold, the copies of texts that
    have many). A text of more than COPIES copies on its side stands for all of them."""
    words, member = copied(stored(segment_words(segments, specs), "segment-words"))
    return verified(stored(candidates(words), "candidates"), words), member


def spread(pairs: DataFrame, member: DataFrame | None, key: str) -> DataFrame:
    """Pairs with the id in `key` replaced by each copy of its text; copies of a text are spread over tasks, HOT to each."""
    if member is None:
        return pairs
    parts = F.ceil(F.col("copies") / HOT).cast("int")
    size = member.groupBy(F.col("rep").alias(key)).agg(F.max(parts).alias("parts"))
    every = member.select(F.col("rep").alias(key), F.pmod(F.xxhash64("segment_id"), parts).cast("int").alias("salt"), "segment_id")
    salted = pairs.join(small(size, 16), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return salted.join(every, [key, "salt"], "left").withColumn(key, F.coalesce("segment_id", key)).select(*pairs.columns)


def found(segments: DataFrame, specs: DataFrame) -> DataFrame:
    """(segment_id_a, segment_id_b), the smaller id first. Texts under LEAST_WORDS words, without split or NULL have no pairs."""
    pairs, member = overlaps(segments, specs)
    pairs = spread(spread(pairs.select("eval_id", "train_id"), member, "eval_id"), member, "train_id")
    return pairs.select(F.least("eval_id", "train_id").alias("segment_id_a"), F.greatest("eval_id", "train_id").alias("segment_id_b")).distinct()


def report(segments: DataFrame, specs: DataFrame) -> DataFrame:
    """(split, subject, segments, leaked, exact): evaluation segments of LEAST_WORDS words and more that come back in train, per split and subject."""
    pairs, member = overlaps(segments, specs)
    hit = spread(pairs.groupBy("eval_id").agg(F.min("edits").alias("edits")), member, "eval_id").groupBy(F.col("eval_id").alias("segment_id")).agg(F.min("edits").alias("edits"))
    split = specs.where("spec_id is not null").groupBy("spec_id").agg(F.max(role(F.col("split"))).alias("split")).where("split in ('val', 'test')")
    own = segments.where("segment_id is not null").groupBy("segment_id").agg(F.max(F.struct("spec_id", "subject")).alias("x")).select("segment_id", "x.*")
    both = own.join(small(split, 24), "spec_id").join(hit, "segment_id", "left")
    return both.groupBy("split", subject_key(F.col("subject")).alias("subject")).agg(F.count("*").alias("segments"), F.count("edits").alias("leaked"), F.count_if(F.col("edits") == 0).alias("exact"))
