"""Problem 4: broken prompt and response pairs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bytewords import Scan, slices, word_hash
from lectern.llm.languages import STOPWORDS
from lectern.runtime import stored

#: What stands for an answer that isn't there.
EMPTY = frozenset(["", "a", "ans", "answer", "explanation", "na", "n a", "nil", "none", "null", "nan", "tba", "tbd", "todo", "response", "antwort", "réponse", "respuesta"])
#: Words that may stand around a copied question; words of a lead-in, before a colon, that may stand before it.
FRAME, LEAD = frozenset("question the is q a answer was asked frage la pregunta es die lautet est".split()), 5
#: A copied stretch has at least so many words; an answer is a copy if all but FRAME words are covered by such stretches.
COPIED = 3
#: Word classes of the refusal automata. Class `unable` also has `not` beside a word of ABLE, and `'t`.
CLASSES = {
    "person": "i me my myself we us our ich mir mich wir je nous moi yo nosotros",
    "unable": "cannot unable decline refuse impossible sorry apologies unfortunately kann leider ne désolé no siento",
    "able": "able can could",
    "speech": "answer answering answered respond response reply help assist provide explain explanation discuss say comment access know supplied give complete completed fulfil fulfill process processed share beantworten antworten helfen répondre aider responder ayudar",
    "negation": "not no insufficient",
    "lack": "enough sufficient insufficient",
    "ground": "context information info details detail material data",
    "asked": "request question query prompt",
    "source": "source sources passage passages page pages text document material context provided supplied",
    "nothing": "nothing nowhere",
    "none": "no none",
    "reply": "answer answers response explanation",
    "may": "can could be was is",
    "got": "found given provided located determined derived supplied",
}
ABLE = "able possible can could do know going"
#: What a refusal says, as classes in order with anything between; one automaton each. The second list is void where who or which stands.
REFUSALS = """
person unable speech
unable person speech
speech person unable
speech unable person
unable speech person
speech negation person able
negation lack ground speech
negation lack ground source
lack ground speech negation
ground negation speech lack
source negation speech lack
source nothing person speech
none reply may got source
""".split("\n")[1:-1]
REQUESTS = ["unable speech asked", "asked unable speech", "unable asked speech"]
#: Runs of words that no person says.
SELF = (("as", "a", "language", "model"), ("as", "an", "ai"), ("as", "an", "assistant"))
#: A word that is seen so often and never before a full stop can't end an answer.
KNOWN, PAIRED = 20, 10

#: Characters without width.
HIDDEN = "[\u200b-\u200f\u2060\ufeff]"
_BARE = re.compile(r"[^\W_]+")
_STOP = re.compile(r"[.!?。？！]['\"”’»)\]]*\s*$")
_CUT = re.compile(r"(\.\.\.|…|\[\.\.\.\]|\[…\])\s*$")
_OPEN = "([{“«„\""


class Automaton:
    """Suffix automaton of a list of words."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, last = [-1], [0], 0
        for w in words:
            now = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[q] == self.length[p] + 1:
                    self.link[now] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.link.append(self.link[q])
                    self.length.append(self.length[p] + 1)
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = copy
                        p = self.link[p]
                    self.link[q] = self.link[now] = copy
            last = now

    def matched(self, words: list[str]) -> list[int]:
        """For each word the length of the longest stretch that ends there and stands in the automaton's words."""
        state = n = 0
        out = []
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            else:
                state = n = 0
            out.append(n)
        return out


def uncovered(question: list[str], answer: list[str], least: int = COPIED) -> list[str]:
    """Words of the answer outside of stretches of at least `least` words (or the whole question) copied from the question."""
    need = min(least, max(1, len(question)))
    covered = [False] * len(answer)
    for i, n in enumerate(Automaton(question).matched(answer)):
        if n >= need:
            covered[i - n + 1 : i + 1] = [True] * n
    return [w for w, c in zip(answer, covered) if not c]


class Refusals:
    """The automata of REFUSALS and REQUESTS side by side, a bit a state, run over all sentences of a batch at once.

    A state is reached when the words of the classes up to it have come in order; each word moves an automaton by one state at most.
    """

    def __init__(self):
        sets = {k: set(word_hash(v.split()).tolist()) for k, v in CLASSES.items()}
        self.first = self.final = self.request = 0
        at, accept = 0, {k: 0 for k in CLASSES}
        for pattern in [*REFUSALS, *REQUESTS]:
            steps = pattern.split()
            self.first |= 1 << at
            for k in steps:
                accept[k] |= 1 << at
                at += 1
            self.final |= 1 << (at - 1)
            self.request |= (1 << (at - 1)) * (pattern in REQUESTS)
        every = sorted(set().union(*sets.values()))
        self.word = np.array(every, np.int64)
        self.bits = np.array([sum({bit for k, v in sets.items() if w in v for bit in _single(accept[k])}) for w in every], np.uint64)
        self.unable, self.negation = np.uint64(accept["unable"]), np.uint64(accept["negation"])
        self.able, self.not_, self.t, self.who = (np.sort(word_hash(x.split())) for x in (ABLE, "not", "t", "who which"))
        self.self = [word_hash(list(x)) for x in SELF]

    def rows(self, scan: Scan, n: int) -> np.ndarray:
        """Which of the n rows refuse in one of their sentences."""
        out, h = np.zeros(n, bool), scan.hash
        if not len(h):
            return out
        for run in self.self:
            at = np.arange(max(0, len(h) - len(run) + 1))
            for j, w in enumerate(run):
                at = at[h[at + j] == w]
            out[scan.row[at[scan.row[at] == scan.row[at + len(run) - 1]]]] = True
        at = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
        bits = np.where(self.word[at] == h, self.bits[at], np.uint64(0))
        near, not_ = np.isin(h, self.able), np.isin(h, self.not_)
        beside = np.concatenate([near[1:], [False]]) | np.concatenate([[False], near[:-1]])
        before = scan.code[np.maximum(scan.start - 1, 0)]
        short = np.isin(h, self.t) & np.isin(before, [39, 0x2019])
        bits = bits | np.where((not_ & beside) | short, self.unable, np.uint64(0)) | np.where(short, self.negation, np.uint64(0))
        sentence = stretches(scan)
        live = np.flatnonzero(bits)
        names, own = np.unique(sentence[live], return_inverse=True)
        first = np.searchsorted(own, np.arange(len(names)))
        rank = np.arange(len(live)) - first[own]
        state = np.zeros(len(names), np.uint64)
        for step in range(int(rank.max(initial=-1)) + 1):
            now = np.flatnonzero(rank == step)
            k = own[now]
            state[k] |= ((state[k] << np.uint64(1)) | np.uint64(self.first)) & bits[live[now]]
        asked = np.isin(names, sentence[np.isin(h, self.who)])
        said = (state & np.where(asked, np.uint64(self.final & ~self.request), np.uint64(self.final))) != 0
        out[scan.row[live[first[said]]]] = True
        return out


def _single(bits: int) -> list[int]:
    return [1 << i for i in range(bits.bit_length()) if bits >> i & 1]


def stretches(scan: Scan) -> np.ndarray:
    """Number of the sentence of each word: a new one begins with a row and after . ! ? or ; with white space behind it."""
    code = scan.code
    stop = np.isin(code[:-1], [33, 46, 59, 63]) & np.isin(code[1:], [9, 10, 13, 32, 0xA0])
    seen = np.concatenate([[0], np.cumsum(stop), [0]])[scan.start] if len(code) > 1 else np.zeros(len(scan.start), np.int64)
    return seen + scan.row * (int(stop.sum()) + 1)


def unlike(scan: Scan, asked: Scan) -> np.ndarray:
    """Which words of a row stand neither in the row of the other scan nor in FRAME."""
    mix = lambda s: s.hash ^ (s.row.astype(np.int64) * 0x9E3779B97F4A7C1)
    return ~np.isin(mix(scan), mix(asked)) & ~np.isin(scan.hash, word_hash(sorted(FRAME)))


def votes(scan: Scan, n: int) -> np.ndarray:
    """Function words of each language (columns, as in STOPWORDS) in each row."""
    return np.stack([np.bincount(scan.row[np.isin(scan.hash, word_hash(sorted(set(v.split()))))], minlength=n) for v in STOPWORDS.values()], axis=1)


def unbalanced(text: str) -> bool:
    """An opening bracket or quotation mark is never closed (delimiter stack; numbering such as `1)` closes nothing)."""
    stack: list[str] = []
    pairs = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
    for c in text:
        if c == "“" and stack and stack[-1] == "„":
            stack.pop()
        elif c in "([{“«„":
            stack.append(c)
        elif c in pairs and stack and stack[-1] == pairs[c]:
            stack.pop()
    return bool(stack) or text.count('"') % 2 == 1


def copies(question: str, text: str) -> bool:
    """All words of the answer, but FRAME words and a lead-in before a colon, are copied from the question in stretches."""
    asked = _BARE.findall(question.lower())
    for part in (text, text.partition(":")[2] if len(_BARE.findall(text.partition(":")[0])) <= LEAD else ""):
        bare = _BARE.findall(part.lower())
        if asked and bare and len(bare) >= min(COPIED, len(asked)) and all(w in FRAME for w in uncovered(asked, bare)):
            return True
    return False


def judged(question: pa.Array, answer: pa.Array, refusals: Refusals) -> tuple[list, list, list]:
    """(defect, last word, word before it) of each row: the last two only where the answer has no final stop and may be cut off.

    Words, sentences, votes and ends are looked up for the whole batch; the copy automaton, the delimiter stack and the rules for short answers
    run only where the words, the delimiters or the length leave the defect possible.
    """
    n = len(answer)
    said, asked = Scan(answer), Scan(question)
    k = np.bincount(said.row, minlength=n)
    refused = refusals.rows(said, n)
    copied = (k - np.bincount(said.row[~unlike(said, asked)], minlength=n) <= LEAD) & (k > 0)
    mine, theirs = votes(said, n), votes(asked, n)
    best, rival = mine.argmax(1), theirs.argmax(1)
    lead = lambda v: np.sort(v, axis=1)[:, -1] > np.sort(v, axis=1)[:, -2]
    at = np.arange(n)
    foreign = lead(mine) & lead(theirs) & (best != rival) & (mine[at, best] >= 2) & (mine[at, best] > 2 * mine[at, rival])
    spaced = np.isin(said.code, [9, 10, 11, 12, 13, 32, 0xA0])
    solid = np.concatenate([[-1], np.maximum.accumulate(np.where(spaced, -1, np.arange(len(said.code))))]) if len(said.code) else np.array([-1])
    last = solid[said.row_start[1:]]
    end = np.where(last >= said.row_start[:-1], said.code[np.maximum(last, 0)] if len(said.code) else 0, 0)
    opens = np.zeros(n, bool)
    opens[np.searchsorted(said.row_start, np.flatnonzero(np.isin(said.code, [ord(c) for c in _OPEN])), side="right") - 1] = True
    stopped = np.isin(end, [ord(c) for c in ".!?。？！"])
    ended = np.isin(end, [ord(c) for c in "'\"”’»)]…"])
    dangling = np.isin(end, [ord(c) for c in ",;:(-–—"]) & (k > 1)
    dots = stopped & (said.code[np.maximum(last - 1, 0)] == 46 if len(said.code) else False)
    defect: list[str | None] = [None] * n
    words: list[str | None] = [None] * n
    before: list[str | None] = [None] * n
    plain = ~(refused | copied | foreign | opens | ended | dangling | dots | (k <= 2)) & (stopped | (k < 4))
    for i in np.flatnonzero(~plain):
        text = answer[i].as_py() or ""
        if k[i] <= 2 and " ".join(_BARE.findall(text.lower())) in EMPTY:
            defect[i] = "empty"
        elif refused[i]:
            defect[i] = "refusal"
        elif copied[i] and copies(question[i].as_py() or "", text):
            defect[i] = "copies_question"
        elif foreign[i]:
            defect[i] = "wrong_language"
        elif k[i] > 1 and (dangling[i] or _CUT.search(text) or opens[i] and unbalanced(text)):
            defect[i] = "truncated"
        elif not _STOP.search(text) and k[i] >= 4:
            before[i], words[i] = _BARE.findall(text.lower())[-2:]
    return defect, words, before


def judge(question: str | None, answer: str | None) -> tuple[str | None, str | None, str | None]:
    """judged of one pair."""
    d, w, b = judged(pa.array([question], pa.string()), pc.replace_substring_regex(pa.array([answer], pa.string()), HIDDEN, ""), Refusals())
    return d[0], w[0], b[0]


def answers(items: DataFrame) -> DataFrame:
    """(item_id, question, answer): the answer of flashcards, the explanation of quizzes. Rows that repeat an item_id are one item."""
    said = F.regexp_replace(F.when(F.col("item_kind") == "quiz", F.col("explanation")).otherwise(F.col("answer")), HIDDEN, "")
    return items.where("item_id is not null").select("item_id", "question", said.alias("answer")).groupBy("item_id").agg(F.max(F.struct("question", "answer")).alias("x")).select("item_id", "x.*")


def endings(said: DataFrame) -> DataFrame:
    """(word, before, n, stops): how often a word, and a word after another (before not NULL), stands in all answers and how often it closes
    a sentence or a short answer. An answer without a final stop doesn't count its last word unless it is short."""
    text = F.lower(F.coalesce("answer", F.lit("")))
    marked = F.regexp_replace(text, r"([.!?])(?=\s|$|[\"'”’»)])", " \x01 ")
    marks = F.regexp_extract_all(marked, F.lit(r"[\p{L}\p{N}]+|\x01"), F.lit(0))
    rows = said.select(marks.alias("w")).withColumn("w", F.when(F.size("w") < 5, F.concat("w", F.array(F.lit("\x01")))).otherwise(F.col("w")))
    place = lambda x, i: F.struct(x.alias("word"), F.get("w", i - 1).alias("before"), (F.get("w", i + 1) == "\x01").cast("long").alias("stop"))
    at = rows.select(F.inline(F.transform("w", place))).where((F.col("word") != "\x01") & F.col("stop").isNotNull())
    return at.groupBy("word", "before").agg(F.count("*").alias("n"), F.sum("stop").alias("stops"))


def found(items: DataFrame) -> DataFrame:
    """(item_id, defect), at most one a item; NULL item_id is dropped, NULL and blank answers are empty.

    Order: empty, refusal, copies_question, wrong_language, truncated. An answer without a final stop is cut off if it ends in an
    ellipsis, an open bracket or a comma, in a part of a word (not a word of the answers, but the beginning of one), or in a word
    that is seen often and never closes a sentence.
    """
    said = stored(answers(items), "answers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refusals = Refusals()
        for b in (part for batch in batches for part in slices(batch, 2)):
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.string()) for x in judged(b.column(1), b.column(2), refusals))], names=["item_id", "defect", "last", "before"])

    kind = dict(items.dtypes)["item_id"]
    judged_ = said.mapInArrow(run, f"item_id {kind}, defect string, last string, before string").where("defect is not null or last is not null")
    judged_ = stored(judged_, "judged")
    pairs = stored(endings(said), "endings")
    word = pairs.groupBy("word").agg(F.sum("n").alias("n"), F.sum("stops").alias("stops"))
    parts = word.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - 1, F.lit(1))), lambda i: F.left("word", i))).alias("part")).distinct()
    open_ = judged_.where("last is not null").select("item_id", "last", "before")
    seen = open_.join(word.withColumnRenamed("word", "last"), "last", "left")
    seen = seen.join(pairs.where("before is not null").select(F.col("word").alias("last"), "before", F.col("n").alias("n2"), F.col("stops").alias("stops2")), ["last", "before"], "left")
    seen = seen.join(parts.withColumnRenamed("part", "last").withColumn("is_part", F.lit(True)), "last", "left")
    fragment = F.col("n").isNull() & F.col("is_part") & ~F.col("last").rlike(r"^\d+$")
    never = (F.col("n") >= KNOWN) & (F.col("stops") * 200 < F.col("n"))
    inner = (F.col("n2") >= PAIRED) & (F.col("stops2") == 0) & (F.col("stops") * 10 < F.col("n"))
    cut = seen.where(F.coalesce(fragment, F.lit(False)) | F.coalesce(never, F.lit(False)) | F.coalesce(inner, F.lit(False))).select("item_id", F.lit("truncated").alias("defect"))
    return judged_.where("defect is not null").select("item_id", "defect").unionByName(cut)
