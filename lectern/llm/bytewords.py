"""Vectorised word scanner for Arrow batches: words of whole columns of text as hashes, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Characters of text that are scanned at once; bounds the memory of a task, not what is read.
SLICE = 1 << 18


_TABLES: dict[str, np.ndarray] = {}


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is letter or digit, lower case) by code point of the basic plane, (random odd multipliers by place in a word)."""
    if not _TABLES:
        chars = [chr(c) for c in range(0x10000)]
        _TABLES["word"] = np.array([c.isalnum() for c in chars])
        _TABLES["lower"] = np.array([ord(c.lower()[0]) for c in chars], dtype=np.uint16)
        _TABLES["power"] = np.random.default_rng(20240229).integers(1, 1 << 62, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _TABLES["word"], _TABLES["lower"], _TABLES["power"]


def word_hash(words: list[str]) -> np.ndarray:
    """The hashes that Scan gives to these (single) words."""
    return Scan(pa.array(words, pa.string())).hash if words else np.zeros(0, np.int64)


class Scan:
    """Words of a column of text: maximal runs of letters and digits, case ignored.

    code: code points of all rows on end; row_start: first code point of each row (and the end); start, end: range of each word in
    code; row: row of each word; hash: 64-bit hash of each word. NULL rows have no words.
    """

    def __init__(self, column: pa.Array):
        word, lower, power = tables()
        column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = column.buffers()[2]
        data = memoryview(raw)[offsets[0] : offsets[-1]] if raw is not None else b""
        offsets = offsets - offsets[0]
        if column.null_count:  # a NULL slot may hold bytes
            valid = column.is_valid().to_numpy(zero_copy_only=False)
        else:
            valid = None
        byte = np.frombuffer(data, np.uint8)
        if len(byte) and byte.max() >= 0x80:
            self.code = np.frombuffer(str(data, "utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
            self.row_start = np.concatenate([[0], np.cumsum((byte & 0xC0) != 0x80)])[offsets]
        else:
            self.code, self.row_start = byte, offsets
        code = self.code
        high = code >= 0x10000 if code.dtype == np.uint32 and len(code) and code.max() >= 0x10000 else None
        is_word = word[code if high is None else np.where(high, 0, code)]
        if high is not None:
            kinds, at = np.unique(code[high], return_inverse=True)
            is_word[high] = np.array([chr(c).isalnum() for c in kinds])[at]
        # a word begins or ends where the flag changes, and at the border of a row inside letters
        change = np.empty(len(code) + 1, bool)
        change[:1] = change[-1:] = True
        np.not_equal(is_word[1:], is_word[:-1], out=change[1:-1])
        change[self.row_start] = True
        cuts = np.flatnonzero(change)
        real = np.flatnonzero(is_word[cuts[:-1]]) if len(code) else np.zeros(0, np.int64)
        self.start, self.end = cuts[real], cuts[real + 1] if len(real) else real
        self.row = np.searchsorted(self.row_start, self.start, side="right") - 1
        if valid is not None:
            keep = valid[self.row]
            self.start, self.end, self.row = self.start[keep], self.end[keep], self.row[keep]
        size = self.end - self.start
        shift = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(self.start - shift, size)
        place = at - np.repeat(self.start, size)
        letters = code[at]
        small = lower[letters if high is None else np.where(letters >= 0x10000, 0, letters)].astype(np.uint64)
        if high is not None:
            rare = letters >= 0x10000
            kinds, which = np.unique(letters[rare], return_inverse=True)
            small[rare] = np.array([ord(chr(c).lower()[0]) for c in kinds], dtype=np.uint64)[which] if len(kinds) else 0
        small += np.uint64(1)
        small *= power[place & 1023]
        self.hash = (np.add.reduceat(small, shift) if len(size) else np.zeros(0, np.uint64)).view(np.int64)


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about SLICE bytes of text."""
    if not batch.num_rows:
        return
    column = batch.column(text)
    size = np.cumsum(np.nan_to_num(pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(float)))
    part = (size // SLICE).astype(int)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
