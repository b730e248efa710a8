import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.operators import editor, layout, notes

SEG = "segment_id long, spec_id long, order_index int, text string, page int, label string"


def segments(spark, rows):
    return spark.createDataFrame([(i, 1, i, t, 1, label) for i, (t, label) in enumerate(rows)], SEG)


def test_notes(spark):
    s = segments(spark, [("T", "TITLE"), ("A", "HEADING"), ("One short sentence. Another one that is a bit longer here.", "PARAGRAPH"), ("More words in a second paragraph.", "PARAGRAPH"), ("Example: it rains.", "EXAMPLE"), ("Step 1: go. Step 2: come back.", "PROCEDURE"), ("Definition: Osmosis refers to the movement of water.", "DEFINITION")])
    simple = [(r.type, r.term, r.text) for r in notes.notes(s, "simple").orderBy("block").collect()]
    assert simple[0] == ("bullets", None, "One short sentence.\nAnother one that is a bit longer here.\nMore words in a second paragraph.")
    assert simple[1:] == [("example", None, "it rains."), ("numbered", None, "Go\nCome back"), ("definition", "Osmosis", "The movement of water.")]
    assert notes.notes(s, "smart").where("type = 'bullets'").count() == 1
    assert [r.text for r in notes.objectives(s).collect()] == ["Explain a"]
    parts = notes.outline_parts(notes.outline(s), 60).orderBy("part").collect()
    assert "\n".join(p.text for p in parts) == notes.outline(s).first().text and all(len(p.text) <= 80 for p in parts)


def test_alignment(spark):
    own = spark.createDataFrame([("d", 0, "Alpha  beta"), ("d", 1, "noise"), ("d", 2, "Gamma, delta")], "doc_id string, order_index int, text string")
    src = spark.createDataFrame([("d", 0, "HEADING", "alpha beta"), ("d", 1, "PARAGRAPH", "gamma delta")], "doc_id string, n int, label string, text string")
    assert [r.label for r in notes.aligned(own, src).orderBy("order_index").collect()] == ["HEADING", None, "PARAGRAPH"]


def text(t, *marks):
    return {"type": "text", "text": t, "marks": list(marks)}


def test_editor(spark):
    doc = {"schema_version": 1, "blocks": [{"type": "paragraph", "id": "x", "content": [text("a", "underline", "bold", "bold"), text("b", "bold", "underline"), text("c")]}, {"type": "ordered_list", "id": "x", "start": 3, "items": [{"blocks": [{"type": "paragraph", "content": [text("one")]}]}, {"blocks": [{"type": "paragraph", "content": [text("two", "underline")]}]}]}]}
    bad = [None, "{", '{"blocks": [{"type": "table"}]}', json.dumps({"blocks": [{"type": "paragraph", "color": 1}]}), json.dumps({"blocks": [{"type": "paragraph", "content": [text("a\nb")]}]})]
    df = spark.createDataFrame([(0, json.dumps(doc)), *enumerate(bad, 1)], "k int, c string")
    got = {r.k: r for r in editor.checked(df, "k", "c").collect()}
    assert all(got[i].problem and got[i].content is None for i in range(1, 6)) and got[0].problem is None
    first = json.loads(got[0].content)["blocks"]
    assert first[0]["content"] == [{"type": "text", "text": "ab", "marks": ["bold", "underline"]}, {"type": "text", "text": "c", "marks": []}] and first[1]["id"] != "x"
    again = editor.checked(spark.createDataFrame([(0, got[0].content)], "k int, c string"), "k", "c").first()
    assert again.content_hash == got[0].content_hash
    rows = [(r.marker, r.text, r.underlined) for r in editor.block_rows(df, "k", "c").orderBy("k", "ord").collect()]
    assert rows == [(None, "abc", "a b"), ("3.", "one", ""), ("4.", "two", "two")]


BLOCK = st.deferred(lambda: st.one_of(
    st.builds(lambda c, a: {"type": "paragraph", "align": a, "content": c}, st.lists(INLINE, max_size=3), st.sampled_from(editor.ALIGNS)),
    st.builds(lambda c, n: {"type": "heading", "level": n, "content": c}, st.lists(INLINE, max_size=2), st.integers(1, 3)),
    st.builds(lambda b: {"type": "blockquote", "blocks": b}, st.lists(BLOCK, min_size=1, max_size=2)),
    st.builds(lambda k, i: {"type": k, "items": [{"blocks": b} for b in i]}, st.sampled_from(["bullet_list", "ordered_list"]), st.lists(st.lists(BLOCK, min_size=1, max_size=2), min_size=1, max_size=2)),
))
INLINE = st.one_of(st.just({"type": "hard_break"}), st.builds(lambda t, m, z: {"type": "text", "text": t, "marks": m} | ({"font_size": z} if z else {}), st.text("ab \t", min_size=1, max_size=4), st.lists(st.sampled_from(editor.MARKS), max_size=2), st.sampled_from([None, *editor.SIZES])))


@settings(max_examples=80, deadline=None)
@given(st.lists(BLOCK, min_size=1, max_size=4))
def test_documents_come_back_from_the_editor(blocks):
    try:
        doc = editor.normal(editor.parsed(json.dumps({"blocks": blocks})))
    except editor.Refused as why:
        assert "too deep" in str(why)
        return
    assert editor.from_editor(editor.to_editor(doc)) == doc == editor.normal(editor.parsed(editor.canonical(doc)))
    ids = [b["id"] for _, _, b in editor.walk(doc["blocks"])] + [i["id"] for _, _, b in editor.walk(doc["blocks"]) for i in b.get("items", [])]
    assert len(ids) == len(set(ids))


def test_unknown_editor_nodes():
    tree = {"content": [{"type": "table", "content": [{"type": "row", "content": [{"type": "text", "text": "a\nb"}]}]}, {"type": "bulletList", "content": []}, {"type": "heading", "attrs": {"level": 9, "blockId": "h"}}]}
    got = editor.from_editor(tree, "")["blocks"]
    assert [b["type"] for b in got] == ["paragraph", "paragraph", "heading"] and [n.get("text") for n in got[0]["content"]] == ["a", None, "b"] and got[2]["level"] == 3 and got[2]["id"] == "h"


def test_wrapping(spark):
    t = "The quick brown fox jumps over abcdefghijklmnopqrstuvwxyz\nend"
    got = spark.createDataFrame([(t,)], "t string").select(layout.wrapped(F.col("t"), 10).alias("l")).first().l
    assert all(len(x) <= 10 for x in got) and "".join("".join(got).split()) == "".join(t.split()) and got[-1] == "end"
    p = layout.pages(spark.createDataFrame([("d", i, "word " * 30) for i in range(4)], "k string, ord int, text string"), "k", 10, 7)
    assert p.groupBy("page", "slot").count().where("count > 1").count() == 0 and p.agg(F.max("slot")).first()[0] < 7


def test_spans(spark):
    s = spark.createDataFrame([("d", 1, 1, 1, "Bold ", "Sans-Bold", 12.0, 16, 10.0, 50.0, 40.0, 62.0), ("d", 1, 1, 2, "x", "Serif", 9.0, 0, 40.0, 50.0, 45.0, 62.0), ("d", 1, 2, 1, "first", "Serif", 9.0, 2, 10.0, 20.0, 45.0, 29.0)],
                              "doc_id string, page int, line int, span int, text string, font string, size double, flags int, x0 double, y0 double, x1 double, y1 double")
    got = layout.spans_to_lines(s).orderBy("line").collect()
    assert [(r.text, r.is_bold, r.is_italic, r.size) for r in got] == [("first", False, True, 9.0), ("Bold x", True, False, 12.0)]
    c = spark.createDataFrame([("d", 1, i, ch, y, 10.0) for i, (ch, y) in enumerate([("a", 0.0), ("b", 1.0), ("c", 14.0)])], "doc_id string, page int, n int, c string, y double, size double")
    assert [r.text for r in layout.characters_to_lines(c).orderBy("line").collect()] == ["ab", "c"]
