"""Problem 6: splitting oversized items at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 350, 50
#: Characters of a piece, at most; a token of more is cut between characters.
CHARACTERS = 20_000
#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = frozenset("al approx art bzw ca cap cf ch dr e.g ed eds eq etc ex fig figs i.e jr min mr mrs ms no nr num op p pp prof resp sec sect sr st tab u.a vgl vol vs z.b".split())
_TOKEN = re.compile(r"\S+")
_HEAD = re.compile(r"#{1,6}\s|\d+(\.\d+)+\s+\w|(chapter|section|kapitel|chapitre|capítulo)\s+\d+", re.I)
_END = re.compile(r"[.!?…][\"'”’»)\]]*$")
_OPEN = re.compile(r"[\"'“‘«(\[¿¡]*[A-ZÀ-ÖØ-Þ0-9]")


def tokens(text: Column) -> Column:
    """Number of tokens separated by white space, Unicode blanks included; 0 for NULL and blank text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"))


def _gap(text: str, left: tuple[int, int], right: tuple[int, int]) -> int:
    """Strength of the boundary between two stretches: 0 section, 1 paragraph, 2 line, 3 sentence, 4 word, 5 character."""
    if left[1] == right[0]:
        return 5
    lines = text.count("\n", left[1], right[0])
    if lines:
        return 0 if _HEAD.match(text, right[0]) else 1 if lines > 1 else 2
    word = text[left[0] : left[1]]
    if _END.search(word) and _OPEN.match(text[right[0] : right[1]]):
        bare = word.rstrip(".\"'”’»)]").lstrip("\"'“‘«([").lower()
        if not (word.endswith(".") and (bare in ABBREVIATIONS or len(bare) == 1 and bare.isalpha())):
            return 3
    return 4


def _units(gaps: list[int], fits: Callable[[int, int], bool], a: int, b: int) -> Iterator[tuple[int, int]]:
    """Ranges that fit: cut at the strongest boundary there is, then the parts that are still too long in turn. Where only words and
    characters are left, as many as fit."""
    if fits(a, b):
        yield a, b
        return
    level, start = min(gaps[a : b - 1], default=5), a
    for i in range(a, b - 1):
        if gaps[i] == level if level < 4 else not fits(start, i + 2):
            yield from _units(gaps, fits, start, i + 1) if level < 4 else [(start, i + 1)]
            start = i + 1
    yield from _units(gaps, fits, start, b) if level < 4 else [(start, b)]


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP, characters: int = CHARACTERS) -> list[tuple[str, int, int]]:
    """(piece, tokens, of them repeated from the piece before). Pieces without their repeated tokens are the text in order.

    A token of more than half of `characters` is taken in stretches of that many, each of them a token of its piece.
    """
    most = max(1, characters // 2)
    found = [(i, min(i + most, m.end())) for m in _TOKEN.finditer(text or "") for i in range(m.start(), m.end(), most)]
    if not found:
        return []
    chars = lambda a, b: found[b - 1][1] - found[a][0]
    if len(found) <= limit and chars(0, len(found)) <= characters:
        return [(text[found[0][0] : found[-1][1]], len(found), 0)]
    gaps = [_gap(text, x, y) for x, y in zip(found, found[1:])]
    units = list(_units(gaps, lambda a, b: b - a == 1 or b - a <= max(1, limit - overlap) and chars(a, b) <= most, 0, len(found)))
    out, start, fresh, k = [], 0, 0, 0
    while k < len(units):
        end = units[k][1]
        while k + 1 < len(units) and units[k + 1][1] - start <= limit and chars(start, units[k + 1][1]) <= characters:
            k += 1
            end = units[k][1]
        out.append((text[found[start][0] : found[end - 1][1]], end - start, fresh - start))
        k += 1
        # the overlap starts after the strongest boundary among the last `overlap` tokens, the earliest of that strength
        low = max(end - overlap, fresh)
        while low < end and k < len(units) and chars(low, units[k][1]) > characters:
            low += 1
        fresh, start = end, end
        if overlap and low < end:
            start = min(range(low, end), key=lambda i: (gaps[i - 1] if i else 0, i))
    return out


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(id) of the distinct chunks over the limit, whatever token_count holds. NULL and blank texts have no token."""
    return chunks.where(tokens(F.col("text")) > limit).select("id").where("id is not null").distinct()


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, characters: int = CHARACTERS, oversize_only: bool = False) -> DataFrame:
    """(id, document_id, order_index, piece_index, section_path, text, token_count, overlap_tokens), a row a piece.

    Separator hierarchy: section heading, paragraph, line, sentence, word, character; units are packed greedily up to `limit` tokens and
    `characters` characters, each piece starts with up to `overlap` tokens of the one before, from a natural boundary where there is one.
    Only a token of more than half of `characters` is cut between characters. Chunks within both limits pass unchanged with a right token_count; NULL or blank text gives one piece of 0 tokens. Repeated ids are one chunk (its least text).
    """
    one = chunks.groupBy("id").agg(F.min(F.struct("document_id", "order_index", "section_path", "text")).alias("c")).select("id", "c.*")
    n = tokens(F.col("text"))
    fits = (n <= limit) & (F.length(F.coalesce("text", F.lit(""))) <= characters)
    if oversize_only:
        fits = n <= limit
    within = one.where(fits).select("id", "document_id", "order_index", F.lit(0).alias("piece_index"), "section_path", "text", n.cast("int").alias("token_count"), F.lit(0).alias("overlap_tokens"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.id, r.document_id, r.order_index, i, r.section_path, t, m, o) for r in pdf.itertuples() for i, (t, m, o) in enumerate(cut(r.text, limit, overlap, characters))]
            yield pd.DataFrame(rows, columns=["id", "document_id", "order_index", "piece_index", "section_path", "text", "token_count", "overlap_tokens"])

    schema = "id string, document_id string, order_index int, piece_index int, section_path string, text string, token_count int, overlap_tokens int"
    over = one.where(~fits).select("id", "document_id", F.col("order_index").cast("int"), "section_path", "text").mapInPandas(split, schema)
    return over if oversize_only else within.select(*over.columns).withColumn("order_index", F.col("order_index").cast("int")).unionByName(over)


def found(chunks: DataFrame) -> DataFrame:
    """(id) of the chunks that the splitter cut into more than one piece."""
    return pieces(chunks, oversize_only=True).where("piece_index > 0").select("id").distinct()
