"""Problem 10: keyword-stuffed and link-list pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bytewords import Scan, slices, word_hash
from lectern.llm.languages import STOPWORDS
from lectern.runtime import stored

STATES = ("prose", "apparatus", "link_list", "tag_list", "menu")
#: Further frequent function words, beside those of languages.STOPWORDS.
MORE = "a an can could did do does if many may much no one so some such than them us we you your ab an bis da doch durch etwa vor wird aux dont fait sont entre hay han tan"
#: Probabilities before the fit of each state (rows as STATES) for every bin of a line's features; they say what each state means.
EMISSIONS = {
    "function": ([0.04, 0.12, 0.22], [[0.01, 0.04, 0.15, 0.80], [0.45, 0.15, 0.30, 0.10], [0.80, 0.15, 0.04, 0.01], [0.88, 0.10, 0.015, 0.005], [0.88, 0.10, 0.015, 0.005]]),
    "links": ([0.001, 0.5], [[0.93, 0.06, 0.01], [0.85, 0.12, 0.03], [0.05, 0.15, 0.80], [0.90, 0.08, 0.02], [0.90, 0.08, 0.02]]),
    "tags": ([0.05, 0.25], [[0.90, 0.09, 0.01], [0.60, 0.35, 0.05], [0.60, 0.30, 0.10], [0.05, 0.25, 0.70], [0.50, 0.30, 0.20]]),
    "repeats": ([0.25, 0.60], [[0.75, 0.20, 0.05], [0.80, 0.17, 0.03], [0.30, 0.30, 0.40], [0.10, 0.30, 0.60], [0.05, 0.20, 0.75]]),
    "citation": ([0.5], [[0.99, 0.01], [0.60, 0.40], [0.999, 0.001], [0.999, 0.001], [0.999, 0.001]]),
    "length": ([6.5, 30.5], [[0.10, 0.80, 0.10], [0.60, 0.35, 0.05], [0.40, 0.30, 0.30], [0.30, 0.20, 0.50], [0.30, 0.30, 0.40]]),
}
START = [0.40, 0.30, 0.10, 0.10, 0.10]
MOVES = [[0.70, 0.24, 0.02, 0.02, 0.02], [0.44, 0.50, 0.02, 0.02, 0.02], [0.04, 0.03, 0.87, 0.03, 0.03], [0.04, 0.03, 0.03, 0.85, 0.05], [0.04, 0.03, 0.03, 0.05, 0.85]]
#: The fit: rounds, lines that the probabilities before the fit count for in up to PRIOR_DOCS documents; beyond, in proportion, so that
#: they weigh alike in a table of any size.
ROUNDS, PRIOR, PRIOR_DOCS = 8, 500, 2000
#: Expected counts are summed as whole multiples of 1 / WHOLE, so that the sums are the same in any order of rows.
WHOLE = 1 << 32
#: Lines of a block: longer documents are fitted in blocks that advance together.
BLOCK = 512
#: Bins of each feature; a line's kind is the number of its combination of bins, BINS the bins of each kind.
SHAPE = tuple(len(edges) + 1 for edges, _ in EMISSIONS.values())
BINS = np.stack(np.unravel_index(np.arange(np.prod(SHAPE)), SHAPE), axis=1)
#: A word is repeated if it stands this often in its document.
OFTEN = 3
SHARE = 0.5

#: Units that follow a number on a product tag.
UNITS = "cm mm kg g ml eur usd"


def at(code: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Code points at these places, 0 outside of the text."""
    inside = (place >= 0) & (place < len(code))
    return np.where(inside, code[np.where(inside, place, 0)], 0) if len(code) else np.zeros(len(place), np.uint32)


def breaks(scan: Scan) -> np.ndarray:
    """Line of each word, numbered over all rows: a new line begins with a row, after a line feed, and after a full stop, question
    or exclamation mark with a blank behind it. Lines without words get no number."""
    code = scan.code
    stop = np.isin(code[:-1], [46, 33, 63, 0x2026]) & np.isin(code[1:], [32, 9, 0xA0]) if len(code) > 1 else np.zeros(0, bool)
    mark = code == 10
    mark[:-1] |= stop
    seen = np.concatenate([[0], np.cumsum(mark)])[scan.start] if len(code) else np.zeros(0, np.int64)
    new = np.ones(len(scan.start), bool)
    new[1:] = (np.diff(seen) > 0) | (np.diff(scan.row) > 0)
    return np.cumsum(new) - 1


class Model:
    """Probabilities of the hidden Markov model: start, moves, and of each feature's bins (states x bins, as EMISSIONS)."""

    def __init__(self, start: np.ndarray | None = None, moves: np.ndarray | None = None, tables: list[np.ndarray] | None = None):
        self.start = np.array(START) if start is None else start
        self.moves = np.array(MOVES) if moves is None else moves
        self.tables = [np.array(t) for _, t in EMISSIONS.values()] if tables is None else tables

    def emit(self, bins: np.ndarray) -> np.ndarray:
        """Log probabilities of each line (row of bins, a column a feature) in each state."""
        return sum(np.log(t).T[bins[:, f]] for f, t in enumerate(self.tables))


def borders(kind: np.ndarray, size: np.ndarray, number: np.ndarray, like: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For blocks of documents on end (lines a block, number of the block in its document): the states expected at a block's first line by
    what stands before it, what stands behind a block says of the states of its last line, and the expected moves between blocks."""
    order, first = np.argsort(-size, kind="stable"), np.cumsum(size) - size
    at, falling = first[order], -size[order]
    through = np.eye(len(STATES))[:, :, None] * like[:, kind[at]]
    for t in range(1, int(size.max())):
        n = int(np.searchsorted(falling, -t, side="left"))
        now = (through[:, :, None, :n] * model.moves[None, :, :, None]).sum(1) * like[:, kind[at[:n] + t]]
        through[:, :, :n] = now / now.sum(0).sum(0)
    through[:, :, order] = through.copy()
    enter, leave = np.repeat(model.start[:, None], len(size), axis=1), np.ones((len(STATES), len(size)))
    tail, pairs = np.ones((len(STATES), len(size))), np.zeros((len(STATES), len(STATES)))
    follows = np.flatnonzero(number).tolist()
    for b in follows:
        leave[:, b - 1] = (enter[:, b - 1, None] * through[:, :, b - 1]).sum(0)
        now = (leave[:, b - 1, None] * model.moves).sum(0)
        enter[:, b] = now / now.sum()
    for b in reversed(follows):
        each = model.moves * (through[:, :, b] * tail[:, b]).sum(1)
        both, ahead = leave[:, b - 1, None] * each, each.sum(1)
        pairs += np.rint(both * (WHOLE / both.sum()))
        tail[:, b - 1] = ahead / ahead.sum()
    return enter, tail, pairs


def expected(kind: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """One Baum-Welch pass over documents on end (kind of each line, lines a document), whatever their length: expected starts (states),
    moves (states x states) and lines (states x kinds), flat and in multiples of 1 / WHOLE.

    All blocks of all documents advance together, a line a step, longest first: the lines of a step lie on end. Sums run over single
    elements in a fixed order, so what a document adds doesn't depend on the others.
    """
    if not len(kind):
        return np.zeros(len(STATES) * (1 + len(STATES) + len(BINS)), np.int64)
    logs = model.emit(BINS)
    like = np.exp(logs - logs.max(1, keepdims=True)).T
    parts = -(-lengths // BLOCK)
    doc = np.repeat(np.arange(len(lengths)), parts)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    size = np.minimum(BLOCK, lengths[doc] - number * BLOCK)
    enter, tail, pairs = np.repeat(model.start[:, None], len(size), axis=1), np.ones((len(STATES), len(size))), np.zeros((len(STATES), len(STATES)))
    cut = parts[doc] > 1
    if cut.any():
        enter[:, cut], tail[:, cut], pairs = borders(kind[np.repeat(cut, size)], size[cut], number[cut], like, model)

    order = np.argsort(-size, kind="stable")
    falling, enter, tail = -size[order], enter[:, order], tail[:, order]
    cuts = np.concatenate([[0], np.cumsum(np.searchsorted(falling, -np.arange(-falling[0]), side="left"))])
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    step = np.arange(len(kind)) - np.repeat(np.cumsum(size) - size, size)
    own = np.empty(len(kind), kind.dtype)
    own[cuts[step] + np.repeat(rank, size)] = kind
    held = np.empty((len(STATES), len(kind)))
    now = enter * like[:, own[: cuts[1]]]
    held[:, : cuts[1]] = now / now.sum(0)
    steps = list(zip(cuts.tolist(), cuts[1:].tolist(), cuts[2:].tolist()))
    for a, b, c in steps:
        now = (model.moves.T[:, :, None] * held[None, :, a : a + c - b]).sum(1) * like[:, own[b:c]]
        held[:, b:c] = now / now.sum(0)
    back = tail[:, : cuts[-1] - cuts[-2]]
    for a, b, c in reversed(steps):
        each = model.moves[:, :, None] * (like[:, own[b:c]] * back)[None]
        ahead, before = each.sum(1), held[:, a : a + c - b]
        pairs += np.rint(before[:, None] * each * (WHOLE / (before * ahead).sum(0))).sum(2)
        held[:, b:c] *= back
        back = tail[:, : b - a].copy()
        back[:, : c - b] = ahead / ahead.sum(0)
    held[:, : cuts[1]] *= back
    held *= WHOLE / held.sum(0)
    np.rint(held, out=held)
    start = held[:, : cuts[1]][:, number[order] == 0].sum(1)
    return np.concatenate([start, pairs.ravel(), *[np.bincount(own, weights=h, minlength=len(BINS)) for h in held]]).astype(np.int64)


def updated(counts: np.ndarray, prior: float = PRIOR) -> Model:
    """The model of these expected counts (as expected gives them, in lines); the stated probabilities count as `prior` lines of each state
    for up to PRIOR_DOCS documents, so that documents that lack a kind of line leave its state as it is."""
    base, n = Model(), len(STATES)
    start, moves, lines = counts[:n], counts[n : n + n * n].reshape(n, n), counts[n + n * n :].reshape(n, -1)
    prior *= max(1.0, start.sum() / PRIOR_DOCS)
    start, moves = prior * base.start + start, prior * base.moves + moves
    tables = [prior * t + np.stack([lines[:, BINS[:, f] == k].sum(1) for k in range(t.shape[1])], axis=1) for f, t in enumerate(base.tables)]
    return Model(start / start.sum(), moves / moves.sum(1, keepdims=True), [t / t.sum(1, keepdims=True) for t in tables])


def viterbi(emit: np.ndarray, lengths: np.ndarray, model: Model | None = None) -> np.ndarray:
    """Most likely state of every line. emit: log probabilities of all lines of all documents in order; lengths: lines a document.

    All documents of a batch advance together, a line a step, longest documents first.
    """
    model = model or Model()
    start, moves = np.log(model.start), np.log(model.moves)
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    back = np.zeros(emit.shape, dtype=np.int8)
    score = start + emit[first[size > 0]]
    last = score.copy()
    for t in range(1, int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -t, side="left"))
        every = score[:n, :, None] + moves[None]
        back[first[:n] + t] = every.argmax(1)
        score = every.max(1) + emit[first[:n] + t]
        last[:n] = score
    state = np.zeros(len(emit), dtype=np.int8)
    live = size > 0
    now = last.argmax(1) if len(last) else np.zeros(0, np.int64)
    ends = first[live] + size[live] - 1
    state[ends] = now
    for t in range(int(size[0]) - 1 if len(size) else 0, 0, -1):
        n = int(np.searchsorted(-size, -t, side="left"))
        at = first[:n] + t
        state[at - 1] = back[at, state[at]]
    return state


def seen(scan: Scan, function: np.ndarray, unit: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each line, words of each line, bin of each of its features)."""
    line = breaks(scan)
    first = np.flatnonzero(np.concatenate([[True], np.diff(line) > 0])) if len(line) else np.zeros(0, np.int64)
    row, k = scan.row[first], np.diff(np.append(first, len(line)))
    code, size = scan.code, scan.end - scan.start
    before, after, second = at(code, scan.start - 1), at(code, scan.end), at(code, scan.end + 1)
    head, tail = at(code, scan.start), at(code, scan.end - 1)
    digit, letter = (head >= 48) & (head <= 57), (head >= 97) & (head <= 122) | (head >= 65) & (head <= 90)
    previous = lambda x: np.concatenate([[False], x[:-1]]) if len(x) else x
    joined = previous(scan.end) == scan.start - 1
    joined &= previous(scan.row + 1) == scan.row + 1
    plain = ~np.isin(scan.hash, function) | (before == 60)
    start = np.zeros(len(line), bool)
    start[first] = True
    link = joined & (before == 46) & letter & (size >= 3)
    tags = (before == 35) | (joined & (before == 45) & digit & previous((tail >= 65) & (tail <= 90))) | (np.isin(scan.hash, tag) & (after == 58))
    initial = previous(size == 1) & ~start
    cite = (before == 40) & (after == 41) & digit & (size == 4) & initial
    tags |= (before == 40) & (after == 41) & digit & (size >= 2) & ~cite | joined & np.isin(before, [44, 46]) & digit & (size == 2) & previous(digit)
    tags |= np.isin(scan.hash, unit) & previous(digit)
    cite |= start & digit & np.isin(after, [41, 46]) & (second != 0)
    mixed = scan.hash ^ (scan.row.astype(np.int64) * 0x9E3779B97F4A7C1)
    _, same, often = np.unique(mixed, return_inverse=True, return_counts=True)
    repeated = plain & (often[same] >= OFTEN)
    per = lambda flag: np.bincount(line[flag], minlength=len(k))
    n, content = np.maximum(k, 1), per(plain)
    values = {"function": (k - content) / n, "links": 5 * per(link) / n, "tags": per(tags) / n, "repeats": per(repeated) / np.maximum(content, 1), "citation": per(cite) > 0, "length": k}
    return row, k, np.stack([np.searchsorted(edges, values[name], side="right") for name, (edges, _) in EMISSIONS.items()], axis=1)


def _words() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of function words, units and tag names."""
    function = {w for v in STOPWORDS.values() for w in v.split()} | set(MORE.split())
    return tuple(np.sort(word_hash(sorted(w))) for w in (function, UNITS.split(), ["tag", "tags"]))


def _binary(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """Values on end, n a row, as a binary column."""
    ends = np.concatenate([[0], np.cumsum(n)]) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _values(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values on end, number in each row) of a binary column."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    values = np.frombuffer(memoryview(raw)[ends[0] : ends[-1]] if raw is not None else b"", kind)
    return values, np.diff(ends) // values.itemsize


def observed(documents: DataFrame) -> DataFrame:
    """(doc_id, kinds, words, copies): kind of each line (16 bits) and its words (32 bits) on end; rows that are alike in all this are one.
    NULL doc_id is dropped, NULL and empty texts have no lines."""
    lists = _words()

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, 1)):
            row, k, bins = seen(Scan(b.column(1)), *lists)
            n = np.bincount(row, minlength=b.num_rows)
            kind = np.ravel_multi_index(tuple(bins.T), SHAPE).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([b.column(0), _binary(kind, n), _binary(k.astype(np.int32), n)], names=["doc_id", "kinds", "words"])

    read = documents.where("doc_id is not null").select("doc_id", "text")
    lines = read.mapInArrow(observe, f"doc_id {dict(documents.dtypes)['doc_id']}, kinds binary, words binary")
    return lines.groupBy("doc_id", "kinds", "words").agg(F.count("*").alias("copies"))


def fitted(lines: DataFrame, rounds: int = ROUNDS, prior: float = PRIOR) -> Model:
    """Baum-Welch over all lines of all documents (rows of observed, stored): a pass over them a round. Only the sums reach the driver."""
    model = Model()

    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            for b in (part for batch in batches for part in slices(batch, 0)):
                kind, n = _values(b.column(0), np.uint16)
                sums = expected(kind, n, model)
                at = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["at", "n"])

        sums = lines.where(F.length("kinds") > 0).select("kinds").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
        counts = np.zeros(len(STATES) * (1 + len(STATES) + len(BINS)))
        for r in sums.collect():
            counts[r.at] = int(r.n) / WHOLE
        model = updated(counts, prior)
    return model


def fit(documents: DataFrame) -> Model:
    """The model for these documents: Baum-Welch over all their lines."""
    return fitted(stored(observed(documents), "lines"))


def scored(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, words, prose, apparatus, link_list, tag_list, menu): words of each document by the state of their line.

    The model is fitted to the documents unless given. NULL and empty texts have 0 words; a row that repeats a doc_id is scored again, alike,
    and counts once for the fit. NULL doc_id is dropped. The text is read once; the fit and the scores take the stored lines.
    """
    lines = observed(documents)
    if model is None:
        lines = stored(lines, "lines")
        model = fitted(lines)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = model.emit(BINS)
        for batch in batches:
            for b in slices(batch, 1):
                (kind, n), k = _values(b.column(1), np.uint16), _values(b.column(2), np.int32)[0]
                row, state = np.repeat(np.arange(len(n)), n), viterbi(logs[kind], n, model)
                counts = [np.bincount(row[state == s], weights=k[state == s], minlength=len(n)).astype(np.int32) for s in range(len(STATES))]
                out = pa.RecordBatch.from_arrays([b.column(0), pa.array(sum(counts)), *map(pa.array, counts)], names=["doc_id", "words", *STATES])
                yield out.take(pa.array(np.repeat(np.arange(len(n)), b.column(3).to_numpy())))

    return lines.mapInArrow(score, f"doc_id {dict(documents.dtypes)['doc_id']}, words int, " + ", ".join(f"{s} int" for s in STATES))


def flagged(documents: DataFrame, share: float = SHARE) -> DataFrame:
    s = F.col("link_list") + F.col("tag_list") + F.col("menu")
    return scored(documents).where(s > F.lit(share) * F.col("words")).withColumn("spam_share", F.round(s / F.col("words"), 4))


def found(documents: DataFrame) -> DataFrame:
    """(doc_id): more than half of the words stand in link lists, tag lists or keyword menus."""
    return flagged(documents).select("doc_id").distinct()
