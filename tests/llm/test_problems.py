import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import chunking, leaks, levels, mixing, neardup, overlap, pairs, scans, spam, splits
from lectern.llm.bytewords import Scan

W = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
NOUNS = "river engine temple circle metal harbor magnet theory canyon vessel market mirror palace tariff planet author sample desert voyage column".split()


def sentence(r, n=12):
    return " ".join(r.choice(NOUNS) + r.choice("abcdefgh") * r.randint(0, 2) for _ in range(n)).capitalize() + "."


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=8))
def test_scan_like_python(texts):
    s = Scan(pa.array(texts, pa.string()))
    want = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"(?:(?!_)\w)+", t or "") if w.isalnum()]
    if all(c.isalnum() or not re.match(r"\w", c) or c == "_" for t in texts if t for c in t):
        assert s.row.tolist() == [i for i, _ in want]
        code = s.code
        assert ["".join(map(chr, code[a:b])) for a, b in zip(s.start, s.end)] == [w for _, w in want]


# 1


SPEC = "spec_id long, doc_id string, subject string, author string"


def test_splits(spark):
    rows = [
        (1, "alpha_1-001", "alpha_1", "Smith, J."), (2, "beta_2-001.pdf", "Beta  2.", "J. SMITH"), (3, "gamma_3-001_v2", None, "Staff"), (4, "gamma-3-002 (2)", "delta 4", None),
        (5, "delta_4-009", "unknown", "smith,k"), (6, "./omega_5-001", "", "n/a"), (6, "./omega_5-001", "", "n/a"), (7, None, None, None), (None, "alpha_1-002", "alpha_1", None), (8, "alpha_7-001", "alpha 7", "Jones, B."),
    ]
    got = {r.spec_id: r.group_key for r in splits.found(spark.createDataFrame(rows, SPEC)).collect()}
    assert got == {1: "alpha1", 2: "alpha1", 3: "delta4", 4: "delta4", 5: "delta4", 6: "omega5", 7: "record7", 8: "alpha7"}
    assert splits.found(spark.createDataFrame([], SPEC)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_forest(spark, seed):
    r = random.Random(seed)
    edges = {tuple(sorted((f"n{r.randint(0, 60)}", f"n{r.randint(0, 60)}"))) for _ in range(55)}
    tree, root = splits.forest(spark.createDataFrame([(a, b, 1) for a, b in edges], "u string, v string, n long"))
    head = {}

    def find(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for a, b in edges:
        head[find(a)] = find(b)
    got = {x.node: x.root for x in root.collect()}
    assert len({(find(n), got[n]) for n in got}) == len({find(n) for n in got}) == len(set(got.values()))
    taken = [tuple(x) for x in tree.collect()]
    assert len(taken) == len(got) - len(set(got.values()))


def test_assignment_keeps_groups(spark):
    r = random.Random(1)
    rows = [(i, f"s{min(int(r.expovariate(0.02)), 300)}_x-{i}", None, None) for i in range(3000)]
    target = spark.createDataFrame([("train", 0.7), ("val", 0.15), ("test", 0.15)], "split string, target_share double")
    a = splits.assign(spark.createDataFrame(rows, SPEC), target).toPandas()
    assert len(a) == 3000 and (a.groupby("group_key").new_split.nunique() == 1).all()
    share = a.new_split.value_counts(normalize=True)
    assert abs(share["train"] - 0.7) < 0.03 and abs(share["val"] - 0.15) < 0.03


def test_systematic_dealing(spark):
    assert splits.dealing({"train": 70, "val": 15, "test": 15}, 20).count("train") == 14
    rows = [(i, f"big_x-{i}", None, None) for i in range(1000)] + [(2000 + i, f"s{i // 4}y-{i}", None, None) for i in range(2000)]
    target = spark.createDataFrame([("train", 0.6), ("val", 0.2), ("test", 0.2)], "split string, target_share double")
    a = splits.assign(spark.createDataFrame(rows, SPEC), target).toPandas()
    assert (a.groupby("group_key").new_split.nunique() == 1).all() and a[a.group_key == "bigx"].new_split.iloc[0] == "train"
    assert (abs(a.new_split.value_counts(normalize=True) - [0.6, 0.2, 0.2]) < 0.01).all()


def test_forest_is_kept(spark):
    rows = [(1, "alpha-1", "beta", "Smith, J."), (2, "gamma-1", None, "J. Smith"), (3, "delta-1", None, None)]
    tree = [tuple(sorted(x)) for x in splits.links(spark.createDataFrame(rows, SPEC)).collect()]
    assert len(tree) == 3 and {n for e in tree for n in e} == {"s:alpha", "s:beta", "s:gamma", "a:smith|j"}


# 2


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_overlap_against_brute_force(spark):
    r = random.Random(5)
    texts = [sentence(r, r.randint(15, 40)) for _ in range(60)]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, i % 3, t))
        for j in range(3):
            w = t[:-1].split()
            for _ in range(r.randint(0, int(0.28 * len(w)))):
                k, what = r.randrange(len(w)), r.randint(0, 2)
                w[k : k + 1] = [] if what == 0 else [r.choice(NOUNS)] if what == 1 else [w[k], r.choice(NOUNS)]
            rows.append((1000 + 3 * i + j, (i + j) % 3, " ".join(w)))
    rows += [(5000, 0, texts[1]), (5000, 0, texts[1]), (5001, None, texts[1]), (5002, 1, None), (5003, 1, ""), (None, 1, texts[1]), (5004, 9, texts[1])]
    specs = spark.createDataFrame([(0, " Train"), (1, "VAL"), (2, "test "), (3, None), (9, "other")], "spec_id long, split string")
    got = {tuple(x) for x in overlap.found(spark.createDataFrame(rows, "segment_id long, spec_id long, text string"), specs).collect()}
    valid = {(i, s, tuple(W(t))) for i, s, t in rows if i is not None and s in (0, 1, 2) and len(W(t)) >= 15}
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a in valid for b in valid if a[1] == 0 and b[1] > 0 and distance(a[2], b[2]) * 5 <= max(len(a[2]), len(b[2]))}
    assert got == want and len(want) > 50


def test_overlap_in_parts_and_copies(spark, monkeypatch):
    r = random.Random(6)
    base = [sentence(r, 20) for _ in range(12)]
    rows = [(i, i // 12 % 2, base[i % 12] if i % 7 else " ".join(W(base[i % 12])[:-2] + ["new", "end"])) for i in range(240)]
    specs = spark.createDataFrame([(0, "train"), (1, "test")], "spec_id long, split string")
    df = spark.createDataFrame(rows, "segment_id long, spec_id long, text string")
    want = {(min(a, b), max(a, b)) for a, s, t in rows for b, q, u in rows if s == 0 and q == 1 and distance(W(t), W(u)) * 5 <= 20}
    df, bare = df.withColumn("subject", F.lit("x y")), overlap.segment_words(df, specs)
    words = spark.createDataFrame(bare.collect(), bare.schema)
    monkeypatch.setattr(overlap, "HOT", 3)
    whole = {tuple(x) for x in overlap.candidates(words).collect()}
    monkeypatch.setattr(overlap, "PART_BITS", 1 << 10)
    assert {tuple(x) for x in overlap.candidates(words, 1 << 12).collect()} == whole and len(whole) > 100
    assert {tuple(x) for x in overlap.found(df, specs).collect()} == want
    rep = overlap.report(df, specs).collect()
    assert sum(x.leaked for x in rep) == len({x for p in want for x in p if x // 12 % 2}) and sum(x.segments for x in rep) == 120


def test_long_texts_are_cut_in_stretches():
    w = np.random.default_rng(1).integers(0, 500, (2, 1601)).astype(np.uint64)
    at = overlap.cuts(w, [np.ones(n) for n in overlap.BUCKETS])
    assert at.shape == (2, overlap.edits(1601) + 2) and (np.diff(at, axis=1) > 0).all() and np.diff(at, axis=1).max() <= overlap.PIECE and (at[:, 0] == 0).all() and (at[:, -1] == 1601).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=15, max_size=30), st.lists(st.integers(0, 5), min_size=15, max_size=30))
def test_banded_distance(a, b):
    d = int(overlap.distances([np.array(a)], [np.array(b)])[0])
    k, true = max(len(a), len(b)) // 5, distance(a, b)
    assert d == true if true <= k else d > k


def test_distance_of_long_texts():
    r = np.random.default_rng(5)
    w = r.integers(0, 300, 4000)
    v = np.delete(w, r.choice(4000, 60, replace=False))
    v[r.choice(len(v), 40, replace=False)] = -1
    d = overlap.distances([w, w, w], [v, w, w[::-1]])
    assert 60 <= d[0] <= 100 and d[1] == 0 and d[2] > 800 and int(overlap._banded(w[None, :200], v[None, :195], 200)[0]) == distance(list(w[:200]), list(v[:195]))


def test_pieces_cover_the_text():
    w = np.random.default_rng(0).integers(0, 50, (7, 43)).astype(np.uint64)
    at = overlap.cuts(w, [np.ones(n) for n in overlap.BUCKETS])
    assert at.shape == (7, overlap.edits(43) + 2) and (np.diff(at, axis=1) > 0).all() and (at[:, 0] == 0).all() and (at[:, -1] == 43).all()


# 3


def test_levels(spark):
    r = random.Random(2)
    easy = [" ".join(["The cat sat on the mat with a dog."] * 15 + [f"We see the {r.choice(['hat', 'bus', 'sun', 'cup'])} and it is red." for _ in range(10)]) for _ in range(6)]
    hard = [" ".join("The institutional epistemological methodology of the considerable interdisciplinary investigation necessarily characterizes the multidimensional representation for organizations." for _ in range(12)) for _ in range(6)]
    rows = [(f"e{i}", 1, t) for i, t in enumerate(easy)] + [(f"h{i}", 1, t) for i, t in enumerate(hard)] + [("short", 1, "The cat is on the mat."), ("none", 1, None), (None, 1, easy[0]), ("fr", 1, "Le chat est sur la table et il ne veut pas que les chiens dans la cour soient avec nous. " * 12)]
    rows += [("e0", 1, easy[0])]
    got = {x.document_id: x.level for x in levels.found(spark.createDataFrame(rows, "document_id string, page_number int, text string")).collect()}
    assert got == {**{f"e{i}": "elementary" for i in range(6)}, **{f"h{i}": "university" for i in range(6)}}
    assert levels.found(spark.createDataFrame([], "document_id string, page_number int, text string")).count() == 0


def test_level_is_that_of_the_calibrated_grade(spark):
    rows = [(f"d{i}", 100 + i, 10, 150 + i, 10 + i % 7, float(2 ** (i % 12)), i % 12 + 2.1) for i in range(60)]
    docs = spark.createDataFrame(rows, "document_id string, words long, sentences long, syllable_count long, long_words long, coverage_rank double, grade_formula double")
    level = lambda df: {r.document_id: r.level for r in levels.calibrated(df).select("document_id", levels.level(F.col("grade")).alias("level")).collect()}
    plain = level(docs)
    assert plain == {f"d{i}": "elementary" if i % 12 < 4 else "secondary" if i % 12 < 10 else "university" for i in range(60)}
    one = F.when(F.col("document_id") == "d0", 4000.0).otherwise(F.col("coverage_rank"))
    shifted = level(docs.withColumn("coverage_rank", one))
    assert plain["d0"] == "elementary" != shifted["d0"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aeiyzkle .!?\n5E", max_size=40), max_size=6))
def test_syllables_and_sentences_like_patterns(texts):
    scan = Scan(pa.array(texts, pa.string()))
    words = [w for t in texts for w in re.findall(r"[^\W_]+", t.lower())]
    n = [len(re.findall("[aeiouy]+", w)) for w in words]
    assert levels.syllables(scan).tolist() == [max(1, k - (w.endswith("e") and w[-2:] not in ("le", "ee", "ye") and k > 1)) for w, k in zip(words, n)]
    assert levels.sentences(scan, len(texts)).tolist() == [sum(bool(re.search("[a-zA-Z]{2}", s)) for s in re.split(r"[.!?]+(?=\s|$)", t)) for t in texts]


def test_coverage_rank(spark):
    rows = [("a", 1, "the " * 80 + " ".join(f"w{i}x" for i in range(40)) + "."), ("b", 1, "the " * 50 + "of " * 30 + "and " * 20 + ".")]
    m = {r.document_id: r for r in levels.measured(spark.createDataFrame(rows, "document_id string, page_number int, text string")).collect()}
    assert m["b"].coverage_rank == 2.0 and m["a"].coverage_rank > m["b"].coverage_rank and m["b"].words == 100 and m["b"].sentences == 1


def test_solve():
    a = np.random.default_rng(1).normal(size=(50, 3))
    y = a @ [1.0, -2.0, 0.5]
    assert np.allclose(levels.solve((a.T @ a).tolist(), (a.T @ y).tolist()), [1, -2, 0.5])


# 4


@pytest.mark.parametrize("question,answer,want", [
    ("What is it?", None, "empty"), ("What is it?", "  n/a ", "empty"), ("What is it?", "Answer:", "empty"), ("What is it?", "​", "empty"),
    ("How does heat move in a rod?", "I'm sorry, but I can't help with that.", "refusal"), ("How does heat move in a rod?", "There is not enough heat in the rod, so it fails.", None),
    ("How does heat move in a rod?", "Visitors are sorry to learn that the hall is unable to hold them.", None), ("How does heat move?", "As a language model, I do not have access to it.", "refusal"),
    ("How does heat move in a rod?", "“HOW DOES HEAT MOVE IN A ROD”", "copies_question"), ("How does heat move in a rod?", "The question is: how does heat move in a rod.", "copies_question"),
    ("How does heat move in a rod?", "How does heat move in a rod? It moves from the hot end to the cold end.", None),
    ("How does heat move in a rod?", "Die Wärme bewegt sich in dem Stab und wird von den Enden nicht gehalten.", "wrong_language"), ("Welche Rolle spielt die Wärme und wie?", "Die Wärme ist in dem Stab und geht nicht weg.", None),
    ("How does heat move?", "No answer could be found in the pages provided.", "refusal"), ("How does heat move?", "No answer was found in Orburg until 1780, which explains the heat.", None),
    ("How does heat move?", "The source passage says nothing that would let me answer.", "refusal"), ("How does heat move?", "My apologies - answering questions on heat is not something I can do.", "refusal"),
    ("How does heat move?", "The answer of the reader lets the source pass, and nothing is lost.", None), ("How does heat move?", "Can a rod not answer? It does, I think.", None),
    ("How does heat move in a rod?", "You asked: How does heat move in a rod?", "copies_question"), ("How does heat move in a rod?", "In short: it moves how a rod does in heat.", None),
    ("How does heat move?", "It moves from the hot end to the cold end (as in", "truncated"), ("How does heat move?", "It moves from the hot end to…", "truncated"), ("How does heat move?", "54 percent", None), ("How does heat move?", "1) hot end 2) cold end", None),
])
def test_pairs(question, answer, want):
    assert pairs.judge(question, answer)[0] == want


def test_late_refusal():
    assert pairs.judge("How does heat move in a rod?", "The rod is long. It is warm; it is red. It is old. I'm sorry, but I can't help with that.")[0] == "refusal"
    assert pairs.judge("How does heat move in a rod?", "The rod is long. It is warm; it is red. It is old. The ends are cold.")[0] is None


def test_cut_answers(spark):
    full = [f"The harbor reflects the {a} and the vessel removes the {b}." for a, b in itertools.product(NOUNS, NOUNS)]
    rows = [(i, "flashcard", "Why is that so?", t, None) for i, t in enumerate(full)]
    rows += [(9001, "flashcard", "Why is that so?", "The harbor reflects the river and the", None), (9002, "quiz", "Why is that so?", None, "The harbor reflects the river and the vessel remo"), (9003, "flashcard", "Why is that so?", "The harbor reflects the river and the vessel removes the magnet", None), (9003, "flashcard", "Why is that so?", "The harbor reflects the river and the vessel removes the magnet", None)]
    got = {r.item_id: r.defect for r in pairs.found(spark.createDataFrame(rows, "item_id long, item_kind string, question string, answer string, explanation string")).collect()}
    assert got == {9001: "truncated", 9002: "truncated"}


def test_automaton():
    r = random.Random(0)
    for _ in range(30):
        q, a = [r.choice("abc") for _ in range(12)], [r.choice("abcd") for _ in range(20)]
        got = pairs.Automaton(q).matched(a)
        sub = {tuple(q[i:j]) for i in range(12) for j in range(i + 1, 13)}
        assert got == [max((n for n in range(i + 2) if n == 0 or tuple(a[i + 1 - n : i + 1]) in sub)) for i in range(20)]


# 5


@pytest.mark.parametrize("depth", range(1, neardup.DEPTH + 1))
def test_recall_at_the_threshold(depth):
    found = lambda tries: 1 - (1 - neardup.SHARE**depth) ** tries
    assert found(neardup.tries(depth)) >= neardup.TARGET > found(neardup.tries(depth) - 1)
    assert neardup.trees(depth).shape == (neardup.tries(depth), depth)


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(9)
    rows = []
    for i in range(40):
        w = [x for _ in range(8) for x in W(sentence(r))]
        rows.append((f"d{i:03}", 1, " ".join(w)))
        for j in range(3):
            v = list(w)
            for _ in range(r.randint(0, 14)):
                v[r.randrange(len(v))] = r.choice(NOUNS)
            half = len(v) // 2
            rows += [(f"d{i:03}_{j}", 2, " ".join(v[half:])), (f"d{i:03}_{j}", 1, " ".join(v[:half]))]
    rows += [rows[0], (None, 1, rows[0][2]), ("blank", 1, None), ("short", 1, "one two three"), ("copy", 1, rows[0][2])]
    pages = spark.createDataFrame(rows, "document_id string, page_number int, text string")
    got = {tuple(x) for x in neardup.found(pages).collect()}
    text = {}
    for d, p, t in sorted(set(x for x in rows if x[0])):
        text[d] = text.get(d, "") + " " + (t or "")
    grams = {d: set(zip(w, w[1:], w[2:])) for d, t in text.items() if len(w := W(t)) >= 60}
    want = {(a, b) for a, b in itertools.combinations(sorted(grams), 2) if 2 * len(grams[a] & grams[b]) > len(grams[a] | grams[b])}
    assert len(got & want) >= 0.98 * len(want) and got <= want and ("copy", "d000") in got
    g = {x.document_id: x for x in neardup.groups(pages).collect()}
    assert set(g) == set(grams) and g["copy"].group_id == g["d000"].group_id and sum(x.links for x in g.values()) == 2 * len(got)
    assert neardup.found(pages.limit(0)).count() == 0


# 6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "End.", "Next", "\n", "\n\n", "Fig.", "5", "  ", " "]), max_size=200), st.integers(5, 40), st.integers(0, 4))
def test_pieces(parts, limit, over):
    text = " ".join(parts)
    out = chunking.cut(text, limit, over)
    words = []
    for t, n, o in out:
        assert len(t.split()) == n <= limit and o <= over
        assert not o or words[-o:] == t.split()[:o]
        words += t.split()[o:]
    assert words == text.split()


def test_characters():
    out = chunking.cut("x" * 95 + " end. " + "Next word", 350, 2, 40)
    assert all(len(t) <= 40 for t, _, _ in out)
    assert "".join(t if not o else t.split(" ", o)[-1] if " " in t else "" for t, n, o in out if n > o).replace(" ", "").startswith("x" * 20)
    assert chunking.cut("a b c", 350, 2, 40) == [("a b c", 3, 0)]


def test_boundaries_and_nulls(spark):
    text = "\n\n".join(" ".join(f"w{i}" for i in range(30)) + "." for _ in range(3))
    assert [n for _, n, _ in chunking.cut(text, 40, 5)][0] == 30
    rows = [("a", "d", 0, "p", text), ("a", "d", 0, "p", text), ("b", "d", 1, None, None), ("c", "d", 2, "", " ")]
    c = spark.createDataFrame(rows, "id string, document_id string, order_index int, section_path string, text string")
    got = {(r.id, r.piece_index): (r.token_count, r.section_path) for r in chunking.pieces(c, 40, 5).collect()}
    assert got[("a", 0)] == (30, "p") and got[("b", 0)] == (0, None) and got[("c", 0)] == (0, "") and len(got) == 5
    assert chunking.found(c).count() == 0


# 7


def test_scans(spark):
    clean = "The harbor reflects the market and the vessel. A short-lived theory moves the number again. " * 6
    body = ["The harb0r reflects the rnarket and", "the ves-", "sel of the short-", "lived theory moves ~ the nurnber H2O.", "Where is thc theory now?"]
    lines = [("d", p, i + 1, t) for p in (1, 2) for i, t in enumerate(["Harbor Notes", *body, f"- {p} -"])] + [("d", 1, 1, "Harbor Notes"), (None, 1, 1, "x"), ("d", 3, 1, None)]
    o = spark.createDataFrame(lines, "document_id string, page int, line_no int, text string")
    pages = spark.createDataFrame([("p1", "c", clean, "txt"), ("p2", "d", " ".join(body), "ocr"), ("p3", None, None, None)], "id string, document_id string, text string, source string")
    titles = spark.createDataFrame([("d", "Harbor Notes"), (None, None)], "id string, title string")
    got = {tuple(r) for r in scans.found(o, pages, titles).collect()}
    want = {("d", p, n, k) for p in (1, 2) for n, k in ((1, "furniture"), (7, "furniture"), (2, "misread"), (3, "hyphen"), (5, "misread"), (6, "misread"))}
    assert got == want
    text = scans.repaired(o, pages, titles).first().text
    assert "The harbor reflects the market and the vessel of the short-lived theory moves the number H2O." in text and "Notes" not in text


def test_confusions_both_ways(spark):
    clean = "The circle in the northern barn is clean and clearly the tail of the tall corn is not. " * 6
    read = ["The cirde in the northem bam is", "the dean and the clean tail is", "dearly not the r0of of the barn", "the circle in the northern barn is", "c0in"]
    o = spark.createDataFrame([("d", 1, i + 1, t) for i, t in enumerate(["x x. ", "x x. ", *read, "x x. ", "x x. "])], "document_id string, page int, line_no int, text string")
    pages = spark.createDataFrame([("p1", "c", clean, "txt"), ("p2", "c", "coin roof " * 3, "txt"), ("p3", "d", " ".join(read), "ocr")], "id string, document_id string, text string, source string")
    titles = spark.createDataFrame([("d", "Notes")], "id string, title string")
    lines = {r.line_no: {(x.token, x.meant) for x in r.fixes} for r in scans.analysed(o, pages, titles).collect() if r.fixes}
    assert lines == {3: {("cirde", "circle"), ("northem", "northern"), ("bam", "barn")}, 4: {("dean", "clean")}, 5: {("dearly", "clearly"), ("r0of", "roof")}, 7: {("c0in", "coin")}}


def test_repair_by_tokens(spark):
    clean = "The tail of the market and the vessel with the corn is not long. " * 6
    read = ["Cf cf of cfg, TAIl 0f THE Rnarket and", "the vesscl; cornrn is the fail'", "tail of the market of"]
    o = spark.createDataFrame([("d", 1, i + 1, t) for i, t in enumerate(read)], "document_id string, page int, line_no int, text string")
    pages = spark.createDataFrame([("p1", "c", clean, "txt"), ("p3", "d", " ".join(read), "ocr")], "id string, document_id string, text string, source string")
    text = scans.repaired(o, pages, spark.createDataFrame([("d", "Notes")], "id string, title string")).first().text
    assert text.startswith("Cf cf of cfg, ") and "Market and the vessel; cornrn is the tail' tail" in text


def test_deep_furniture(spark):
    lines = ["Harbor Notes", "Chapter 1", "12", "Harbor Notes", "The vessel is in the harbor of the long,", "Harbor Notes", "old market by the river,", "and the vessel.", "Page 7"]
    o = spark.createDataFrame([("d", 1, i + 1, t) for i, t in enumerate(lines)] + [("d", 2, 1, None)], "document_id string, page int, line_no int, text string")
    pages = spark.createDataFrame([("p3", "d", "x", "ocr")], "id string, document_id string, text string, source string")
    got = {r.line_no for r in scans.found(o, pages, spark.createDataFrame([("d", "Harbor Notes")], "id string, title string")).collect() if r.defect == "furniture"}
    assert got == {1, 3, 4, 9}


def test_rare_words(spark):
    read = ["The rnetamerite and the geosporiire stand with", "the geosporure and the geosporure but not the", "protocline or the protocllne with the neurotene.", "The neurofene is with the neurofene and the neurofene."]
    o = spark.createDataFrame([("d", 1, i + 1, t) for i, t in enumerate(["x x. ", "x x. ", *read, "x x. ", "x x. "])], "document_id string, page int, line_no int, text string")
    pages = spark.createDataFrame([("p1", "c", "The metamerite is not the neurotene.", "txt"), ("p2", "d", " ".join(read), "ocr")], "id string, document_id string, text string, source string")
    titles = spark.createDataFrame([("d", "Notes")], "id string, title string")
    lines = {r.line_no: {(x.token, x.meant) for x in r.fixes} for r in scans.analysed(o, pages, titles).collect() if r.fixes}
    assert lines == {3: {("rnetamerite", "metamerite"), ("geosporiire", "geosporure")}}


def test_misread_second_part(spark):
    clean = "The harbor reflects the market and the nation is not lone with the vessel. " * 6
    read = ["The vessel is not in the har-", "b0r and the barrel of the ves-", "scl with the na-", "flon and the barflon of the mar-", "ket but the rnar-", "kef is not the market."]
    o = spark.createDataFrame([("d", 1, i + 1, t) for i, t in enumerate(read)] + [("d", 2, 1, "the barrel")], "document_id string, page int, line_no int, text string")
    pages = spark.createDataFrame([("p1", "c", clean, "txt"), ("p2", "d", " ".join(read), "ocr")], "id string, document_id string, text string, source string")
    titles = spark.createDataFrame([("d", "Notes")], "id string, title string")
    lines = {r.line_no: {(x.token, x.meant) for x in r.fixes} for r in scans.analysed(o, pages, titles).collect() if r.fixes}
    assert lines == {2: {("b0r", "bor")}, 3: {("scl", "sel")}, 4: {("flon", "tion")}, 5: {("rnar", "mar")}, 6: {("kef", "ket")}}
    assert {r.line_no for r in scans.found(o, pages, titles).collect() if r.defect == "misread"} == {2, 3, 4, 5, 6}
    text = scans.repaired(o, pages, titles).first().text
    assert "harbor and the barrel of the vessel with the nation and the barflon of the market but the market is" in text


# 8


def test_leaks_against_brute_force(spark):
    r = random.Random(4)
    items = [(i, sentence(r, 30)) for i in range(20)] + [(90, None), (91, "too short"), (None, sentence(r, 20)), (3, None)]
    docs = []
    for i in range(120):
        w = W(sentence(r, 25))
        src = W(items[r.randrange(20)][1])
        n = r.randint(9, 16)
        at = r.randrange(len(src) - n)
        docs.append((i, " ".join(w[:10] + src[at : at + n] + w[10:])))
    docs += [docs[0], (500, None), (501, ""), (None, items[0][1])]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(x) for x in leaks.found(d, q).collect()}
    gram = lambda w: {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
    want = {(i, k) for i, t in items if i is not None and t for k, x in docs if k is not None and gram(W(t)) & gram(W(x))}
    assert got == want and len(want) > 30
    assert leaks.found(d.limit(0), q).count() == 0 and leaks.found(d, q.limit(0)).count() == 0


def test_near_leaks(spark):
    r = random.Random(8)
    nouns = [f"{a}{b}" for a in NOUNS for b in "abcdefghij"]
    items = [(i, " ".join(r.choice(nouns) for _ in range(40))) for i in range(30)]
    docs = []
    for i in range(200):
        src, at = items[i % 30][1].split(), r.randrange(10)
        part = src[at : at + 28]
        for k in r.sample(range(28), 3):
            part[k] = r.choice(nouns)
        docs.append((i, " ".join([r.choice(nouns) for _ in range(30)] + part + [r.choice(nouns) for _ in range(30)])))
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.item_id, x.doc_id) for x in leaks.report(d, q).collect()}
    want = {(i % 30, i) for i in range(200)}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 5


# 9


def test_tokens_in_parts(spark, monkeypatch):
    texts = [" ".join(f"word{i} x,\n\n  y" for i in range(200)), "a" * 3000, " " * 700 + "b  c d", None, ""]
    d = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    whole = {r.doc_id: r.tokens for r in mixing.sizes(d).collect()}
    monkeypatch.setattr(mixing, "_PART", re.compile(mixing._PART.pattern.replace(str(mixing.PIECE - 1), "99")))
    assert {r.doc_id: r.tokens for r in mixing.sizes(d).collect()} == whole and whole[3] == whole[4] == 0 and whole[0] > 1000


def test_tree_sums():
    c = np.array([100, 3, 57, 0])
    t = mixing.tree(c, 8)
    assert t.shape == (8, 4) and (t.sum(0) == c).all() and np.ptp(t.sum(1)) <= 3


def test_mixture(spark):
    r = random.Random(0)
    docs = [(i, s, sentence(r, r.randint(5, 40))) for i, s in enumerate(["big"] * 400 + ["Small One"] * 20 + ["other"] * 60 + ["untargeted"] * 30)]
    docs += [docs[0], (9000, "big", None), (9001, None, "x y"), (None, "big", "x")]
    t = spark.createDataFrame([("big", 0.6, 2), ("small_one", 0.2, 3), ("other", 0.1, 3), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    m = mixing.mixture(d, t, 4).toPandas()
    assert set(m.shard) <= {0, 1, 2, 3} and not m.duplicated(["doc_id", "repeat"]).any() and (m.groupby("shard").position.apply(lambda x: sorted(x) == list(range(len(x))))).all()
    rep = mixing.report(d, t, 4).toPandas().set_index("source")
    assert abs(rep.actual_share["big"] - 0.6667) < 0.03 and abs(rep.actual_share["small_one"] - 0.2222) < 0.03 and rep.actual_share["absent"] == 0 and rep.most_uses["small_one"] <= 3
    assert mixing.mixture(d.limit(0), t, 4).count() == 0


# 10


def test_spam(spark):
    r = random.Random(0)
    prose = " ".join("The harbor reflects the market, and it is near the old wall." for _ in range(8))
    soup = " ".join(r.choice(["buy", "cheap", "harbor", "free", "sale"]) for _ in range(80))
    links = "\n".join(f"http://site{i}.example/page" for i in range(30))
    refs = "References\n" + "\n".join(f"Surname{chr(97 + i)}, A. ({1900 + i}). On {NOUNS[i]}s. {NOUNS[-i]} Press." for i in range(15))
    rows = [(1, prose), (2, soup), (3, "A true sentence stands before it.\n" + soup), (4, links), (5, refs), (6, None), (7, ""), (2, soup), (None, soup), (8, prose + "\nsee http://site.example/page"), (9, "#buyharbor #freeharbor #saleharbor " * 20)]
    got = sorted(r.doc_id for r in spam.found(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [2, 3, 4, 9]
    assert spam.scored(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id in (6, 7)").agg(F.sum("words")).first()[0] == 0


def test_viterbi_against_all_paths():
    g = np.random.default_rng(3)
    lengths = np.array([3, 0, 1, 4])
    emit = np.log(g.random((8, 5)))
    got, at = spam.viterbi(emit, lengths), 0
    for n in lengths:
        if n:
            own = emit[at : at + n]
            score = lambda p: np.log(spam.START)[p[0]] + sum(own[i, s] for i, s in enumerate(p)) + sum(np.log(spam.MOVES)[a][b] for a, b in zip(p, p[1:]))
            assert tuple(got[at : at + n]) == max(itertools.product(range(5), repeat=int(n)), key=score)
        at += n


def test_spam_fit_takes_all_lines(spark):
    r = random.Random(5)
    line = lambda: r.choice([sentence(r, 9), f"http://site{r.randint(0, 99)}.example/page", "#buyharbor #freeharbor #saleharbor", "Old Press. (1907)."])
    rows = [(i, "\n".join(line() for _ in range(r.randint(1, 3)))) for i in range(2100)]
    fit = lambda rows, parts=2: spam.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))
    flat = lambda m: np.concatenate([m.start, m.moves.ravel(), *[t.ravel() for t in m.tables]])
    once = flat(fit(rows))
    assert np.allclose(flat(fit(rows + [(i + 10_000, t) for i, t in rows])), once, atol=1e-9)  # twice the corpus, none left out: the same model
    assert (flat(fit(rows[::-1] + rows[:40], 5)) == once).all()  # any order and parts, repeated rows
    assert abs(flat(fit([(1, "\n".join(line() for _ in range(600)))])) - flat(spam.Model())).max() > 0.01  # a long document counts too


@pytest.mark.parametrize("block", [1, 2, 3, 512])
def test_spam_pass_against_all_paths(monkeypatch, block):
    monkeypatch.setattr(spam, "BLOCK", block)
    g = np.random.default_rng(4)
    model, lengths = spam.Model(), np.array([2, 0, 4, 1, 3])
    kind = g.integers(0, len(spam.BINS), lengths.sum()).astype(np.uint16)
    got, want, at = spam.expected(kind, lengths, model), np.zeros(5 * (6 + len(spam.BINS))), 0
    like = np.exp(model.emit(spam.BINS))
    for n in lengths:
        own = kind[at : at + n]
        paths = list(itertools.product(range(5), repeat=int(n))) if n else []
        p = np.array([model.start[s[0]] * np.prod([like[k, x] for k, x in zip(own, s)]) * np.prod([model.moves[a, b] for a, b in zip(s, s[1:])]) for s in paths])
        for s, q in zip(paths, p / p.sum()):
            want[s[0]] += q
            for a, b in zip(s, s[1:]):
                want[5 + 5 * a + b] += q
            for k, x in zip(own, s):
                want[30 + x * len(spam.BINS) + k] += q
        at += n
    assert np.allclose(got / spam.WHOLE, want, atol=1e-7)
