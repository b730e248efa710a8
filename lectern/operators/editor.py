"""Editable documents as JSON: closed schema, normal form, hashes, blocks as rows, differences, editor form, settings."""

from __future__ import annotations

import difflib
import hashlib
import json
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the closed schema allows.
MARKS = ("bold", "italic", "underline")
SIZES = ("small", "normal", "large", "xlarge")
ALIGNS = ("left", "center", "right", "justify")
SCHEMA_VERSION, MAX_TEXT, MAX_BLOCKS, MAX_DEPTH, MAX_ID, MAX_TITLE, MAX_START, MAX_LEVEL, MAX_BYTES = 1, 20_000, 5_000, 4, 64, 300, 10_000, 3, 5 << 20
# Fields of each kind of block, beside id and type, with what a missing one means.
BLOCKS = {
    "heading": {"level": None, "align": "left", "content": ()}, "paragraph": {"align": "left", "content": ()}, "bullet_list": {"items": None},
    "ordered_list": {"start": 1, "items": None}, "blockquote": {"blocks": None},
}


class Refused(ValueError):
    """A document outside of the schema; the message is a code and the place."""


def issued(path: str) -> str:
    """The id of a block without one: from its place, so that equal contents have equal hashes."""
    return "b" + hashlib.sha1(path.encode()).hexdigest()[:10]


def _need(ok: bool, code: str, at: str) -> None:
    if not ok:
        raise Refused(f"{code} at {at or '/'}")


def _inline(nodes: object, at: str) -> list[dict]:
    _need(isinstance(nodes, list), "no list", at)
    out: list[dict] = []
    for i, n in enumerate(nodes):
        here = f"{at}.{i}"
        _need(isinstance(n, dict) and n.get("type") in ("text", "hard_break"), "unknown inline", here)
        if n["type"] == "hard_break":
            _need(set(n) == {"type"}, "unknown field", here)
            out.append({"type": "hard_break"})
            continue
        _need(set(n) <= {"type", "text", "marks", "font_size"}, "unknown field", here)
        text, marks, size = n.get("text"), n.get("marks", []), n.get("font_size")
        _need(isinstance(text, str) and 1 <= len(text) <= MAX_TEXT, "bad text length", here)
        _need("\n" not in text and "\r" not in text, "line break in text", here)
        _need(isinstance(marks, list) and all(m in MARKS for m in marks), "unknown mark", here)
        _need(size is None or size in SIZES, "unknown size", here)
        node = {"type": "text", "text": "".join(c for c in text if c == "\t" or ord(c) >= 32), "marks": [m for m in MARKS if m in marks]}
        out.append(node | ({"font_size": size} if size else {}))
    return out


def _whole(value: object, low: int, high: int, at: str) -> int:
    _need(isinstance(value, int) and not isinstance(value, bool) and low <= value <= high, "bad number", at)
    return value


def _blocks(rows: object, at: str, depth: int, count: list[int]) -> list[dict]:
    _need(isinstance(rows, list), "no list", at)
    out = []
    for i, b in enumerate(rows):
        here = f"{at}/{i}"
        count[0] += 1
        _need(count[0] <= MAX_BLOCKS, "too many blocks", here)
        _need(depth <= MAX_DEPTH, "too deep", here)
        _need(isinstance(b, dict) and b.get("type") in BLOCKS, "unknown block", here)
        fields = BLOCKS[b["type"]]
        _need(set(b) <= {"id", "type", *fields}, "unknown field", here)
        block = {"id": _id(b, here), "type": b["type"]} | {k: b.get(k, d) for k, d in fields.items()}
        if "level" in fields:
            _whole(block["level"], 1, MAX_LEVEL, here)
        if "align" in fields:
            _need(block["align"] in ALIGNS, "unknown align", here)
            block["content"] = _inline(list(block["content"]) if isinstance(block["content"], tuple) else block["content"], here)
        if "start" in fields:
            _whole(block["start"], 0, MAX_START, here)
        if "blocks" in fields:
            block["blocks"] = _blocks(block["blocks"], here + "b", depth + 1, count)
            _need(bool(block["blocks"]), "empty", here)
        if "items" in fields:
            items = block["items"]
            _need(isinstance(items, list) and bool(items), "empty", here)
            block["items"] = []
            for j, item in enumerate(items):
                spot = f"{here}i/{j}"
                _need(isinstance(item, dict) and set(item) <= {"id", "blocks"}, "unknown field", spot)
                inner = _blocks(item.get("blocks"), spot + "b", depth + 1, count)
                _need(bool(inner), "empty", spot)
                block["items"].append({"id": _id(item, spot), "blocks": inner})
        out.append(block)
    return out


def _id(node: dict, at: str) -> str:
    own = node.get("id") or issued(at)
    _need(isinstance(own, str) and len(own) <= MAX_ID, "bad id", at)
    return own


def parsed(raw: str | None) -> dict:
    """The document with defaults and ids; raises Refused."""
    _need(len(raw or "") <= MAX_BYTES, "too large", "")
    try:
        doc = json.loads(raw or "")
    except ValueError:
        raise Refused("not JSON at /") from None
    _need(isinstance(doc, dict) and set(doc) <= {"schema_version", "title", "blocks"}, "unknown field", "")
    _need(doc.get("schema_version", SCHEMA_VERSION) == SCHEMA_VERSION, "unknown version", "")
    title = doc.get("title", "Untitled")
    _need(isinstance(title, str) and len(title) <= MAX_TITLE, "bad title", "")
    return {"schema_version": SCHEMA_VERSION, "title": title, "blocks": _blocks(doc.get("blocks", []), "", 0, [0])}


def problem(raw: str | None) -> str | None:
    """Why a document is refused (code and place), or None."""
    try:
        parsed(raw)
    except Refused as why:
        return str(why)
    return None


def walk(blocks: list[dict], path: str = "", depth: int = 0) -> Iterator[tuple[str, int, dict]]:
    """(path, depth, block) in reading order, the content of lists and quotes included."""
    for i, b in enumerate(blocks):
        at = f"{path}/{i}"
        yield at, depth, b
        for j, item in enumerate(b.get("items", [])):
            yield from walk(item["blocks"], f"{at}i/{j}b", depth + 1)
        yield from walk(b.get("blocks", []), at + "b", depth + 1)


def plain(block: dict) -> str:
    return "".join(n.get("text", "\n") for n in block["content"])


def normal(doc: dict) -> dict:
    """Of a parsed document: runs of one format merged, default size dropped, repeated ids issued anew from their place. Empty paragraphs and
    hard breaks stay."""
    seen: set[str] = set()

    def own_id(node: dict, at: str) -> None:
        k = 0
        while node["id"] in seen or not node["id"]:
            node["id"], k = issued(f"{at}#{k}"), k + 1
        seen.add(node["id"])

    def tidy(blocks: list[dict], path: str) -> None:
        for i, b in enumerate(blocks):
            at = f"{path}/{i}"
            own_id(b, at)
            runs: list[dict] = []
            for n in b.get("content", []):
                n = {k: v for k, v in n.items() if (k, v) != ("font_size", "normal")}
                if runs and n["type"] == "text" and {**runs[-1], "text": ""} == {**n, "text": ""}:
                    runs[-1]["text"] += n["text"]
                else:
                    runs.append(n)
            if "content" in b:
                b["content"] = runs
            for j, item in enumerate(b.get("items", [])):
                own_id(item, f"{at}i/{j}")
                tidy(item["blocks"], f"{at}i/{j}b")
            tidy(b.get("blocks", []), at + "b")

    doc = json.loads(json.dumps(doc))
    tidy(doc["blocks"], "")
    return doc


def canonical(doc: dict) -> str:
    return json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(doc: dict) -> str:
    return hashlib.sha256(canonical(doc).encode()).hexdigest()


def _each(documents: DataFrame, key: str, columns: tuple[str, ...], schema: str, rows: Callable[..., Iterator[tuple]]) -> DataFrame:
    """(key, schema): the rows that a function of the columns of a document gives, batch by batch."""
    kind, names = dict(documents.dtypes)[key], [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, *r) for k, *values in pdf.itertuples(index=False, name=None) for r in rows(*values)]
            yield pd.DataFrame(out, columns=[key, *names])

    return documents.select(key, *columns).mapInPandas(run, f"{key} {kind}, {schema}")


def checked(documents: DataFrame, key: str, content: str) -> DataFrame:
    """(key, problem, content, content_hash): normal form and sha256 of its canonical JSON; a refused or NULL document has a problem instead."""

    def one(raw: str | None) -> Iterator[tuple]:
        try:
            text = canonical(normal(parsed(raw)))
            yield None, text, hashlib.sha256(text.encode()).hexdigest()
        except Refused as why:
            yield str(why), None, None

    return _each(documents, key, (content,), "problem string, content string, content_hash string", one)


def _valid(rows: Callable[..., Iterator[tuple]]) -> Callable[..., Iterator[tuple]]:
    """The function for parsed documents; a refused one has no rows."""

    def run(raw: str | None) -> Iterator[tuple]:
        try:
            doc = parsed(raw)
        except Refused:
            return
        yield from rows(doc)

    return run


def block_rows(documents: DataFrame, key: str, content: str) -> DataFrame:
    """(key, ord, path, depth, type, level, align, indent, marker, quote, empty, group_end, text, underlined): headings and paragraphs in reading
    order. The first of a list item carries its marker and is never empty; group_end marks the last of a top-level block."""

    def flat(doc: dict) -> Iterator[tuple]:
        out: list[list] = []

        def step(blocks: list[dict], path: str, depth: int, indent: int, quote: bool) -> None:
            for i, b in enumerate(blocks):
                at = f"{path}/{i}"
                if "content" in b:
                    under = " ".join(w for n in b["content"] if "underline" in n.get("marks", []) for w in n["text"].split())
                    out.append([at, depth, b["type"], b.get("level"), b["align"], indent, None, quote, not b["content"], False, plain(b), under])
                for j, item in enumerate(b.get("items", [])):
                    first = len(out)
                    step(item["blocks"], f"{at}i/{j}b", depth + 1, indent + 1, quote)
                    out[first][6], out[first][8] = "•" if b["type"] == "bullet_list" else f"{b['start'] + j}.", False
                step(b.get("blocks", []), at + "b", depth + 1, indent + 1, True)
                if not depth and out:
                    out[-1][9] = True

        step(doc["blocks"], "", 0, 0, False)
        yield from ((i, *r) for i, r in enumerate(out))

    schema = "ord long, path string, depth int, type string, level int, align string, indent int, marker string, quote boolean, empty boolean, group_end boolean, text string, underlined string"
    out = _each(documents, key, (content,), schema.replace("level int", "level double"), _valid(flat))
    return out.withColumn("level", F.col("level").cast("int"))


def counts(documents: DataFrame, key: str, content: str) -> DataFrame:
    """(key, blocks, empty_paragraphs, blank_lines, hard_breaks, tokens, underlined): an empty paragraph at the head of a list item is its marker,
    no blank line."""

    def one(doc: dict) -> Iterator[tuple]:
        every = [b for _, _, b in walk(doc["blocks"])]
        lines = [b for b in every if "content" in b]
        empty = sum(b["type"] == "paragraph" and not b["content"] for b in lines)
        heads = [item["blocks"][0] for b in every for item in b.get("items", [])]
        nodes = [n for b in lines for n in b["content"]]
        yield (len(every), empty, empty - sum(h["type"] == "paragraph" and not h["content"] for h in heads), sum(n["type"] == "hard_break" for n in nodes),
               sum(len(plain(b).split()) for b in lines), sum(len(n["text"].split()) for n in nodes if "underline" in n.get("marks", [])))

    return _each(documents, key, (content,), "blocks long, empty_paragraphs long, blank_lines long, hard_breaks long, tokens long, underlined long", _valid(one))


def outline_lines(doc: dict) -> list[str]:
    """A line for each block, indented by its depth: headings with #, lists and quotes by their type."""
    kind = {"heading": lambda b: f"{'#' * b['level']} {plain(b)}", "paragraph": plain}
    return ["  " * depth + kind.get(b["type"], lambda b: f"[{b['type']}]")(b) for _, depth, b in walk(doc["blocks"])]


def block_diff(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, n, op, old, new): the changes that make the old document's blocks the new one's, in order; old and new hold the lines of each."""

    def one(a: str | None, b: str | None) -> Iterator[tuple]:
        try:
            x, y = outline_lines(parsed(a)), outline_lines(parsed(b))
        except Refused:
            return
        codes = [c for c in difflib.SequenceMatcher(a=x, b=y, autojunk=False).get_opcodes() if c[0] != "equal"]
        yield from ((n, op, "\n".join(x[i:j]), "\n".join(y[k:m]), j - i, m - k) for n, (op, i, j, k, m) in enumerate(codes))

    return _each(pairs, key, (old, new), "n long, op string, old string, new string, removed long, added long", one)


def compose(blocks: DataFrame, key: str, order: list[str], titles: DataFrame) -> DataFrame:
    """(key, content): documents of rows (key, *order, kind, level, align, lines): heading, paragraph (lines apart by hard breaks), bullet_list or
    ordered_list (a line an item). titles(key, title) names the documents; one without rows has no blocks. Blank lines are dropped."""
    text = lambda x: F.to_json(F.struct(F.lit("text").alias("type"), x.alias("text")))
    par = lambda inner, align: F.concat(F.lit('{"type":"paragraph","align":"'), align, F.lit('","content":['), inner, F.lit("]}"))
    lines = F.filter("lines", lambda x: F.trim(x) != "")
    align, broken = F.coalesce("align", F.lit("left")), F.array_join(F.transform(lines, text), ',{"type":"hard_break"},')
    items = F.array_join(F.transform(lines, lambda x: F.concat(F.lit('{"blocks":['), par(text(x), F.lit("left")), F.lit("]}"))), ",")
    head = F.concat(F.lit('{"type":"heading","level":'), F.col("level").cast("string"), F.lit(',"content":['), broken, F.lit("]}"))
    listed = F.concat(F.lit('{"type":"'), F.col("kind"), F.lit('","items":['), items, F.lit("]}"))
    j = F.when(F.col("kind") == "heading", head).when(F.col("kind") == "paragraph", par(broken, align)).otherwise(listed)
    rows = blocks.where(F.size(lines) > 0).select(key, F.struct(*order, j.alias("j")).alias("x"))
    own = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["j"]), ",").alias("l"))
    named = F.regexp_replace(F.to_json(F.struct(F.left(F.col("title"), F.lit(MAX_TITLE)).alias("title"))), r"\}$", "")
    return titles.join(own, key, "left").select(key, F.concat(named, F.lit(',"blocks":['), F.coalesce("l", F.lit("")), F.lit("]}")).alias("content"))


# Names that the editor's own format uses.
NODES = {"bullet_list": "bulletList", "ordered_list": "orderedList", "heading": "heading", "paragraph": "paragraph", "blockquote": "blockquote"}
CSS = {"small": "0.85em", "large": "1.2em", "xlarge": "1.4em"}


def to_editor(doc: dict) -> dict:
    """A parsed document in the editor's format; one without blocks gets an empty paragraph."""

    def inline(n: dict) -> dict:
        if n["type"] == "hard_break":
            return {"type": "hardBreak"}
        marks = [{"type": m} for m in MARKS if m in n["marks"]]
        size = CSS.get(n.get("font_size"))
        marks += [{"type": "textStyle", "attrs": {"fontSize": size}}] if size else []
        return {"type": "text", "text": n["text"]} | ({"marks": marks} if marks else {})

    def node(b: dict) -> dict:
        attrs: dict = {"blockId": b["id"]}
        if "content" in b:
            attrs["textAlign"] = None if b["align"] == "left" else b["align"]
            inner = [inline(n) for n in b["content"]]
        else:
            inner = [{"type": "listItem", "attrs": {"blockId": x["id"]}, "content": list(map(node, x["blocks"]))} for x in b["items"]] if "items" in b else list(map(node, b["blocks"]))
        attrs |= {k: b[k] for k in ("level", "start") if k in b}
        return {"type": NODES[b["type"]], "attrs": attrs} | ({"content": inner} if inner else {})

    return {"type": "doc", "content": list(map(node, doc["blocks"])) or [{"type": "paragraph", "attrs": {"blockId": None, "textAlign": None}}]}


def from_editor(tree: dict, title: str = "Untitled") -> dict:
    """The editor's format as a document: unknown nodes become paragraphs of their text, line feeds in texts hard breaks, empty lists and items
    get a paragraph, missing ids come from their place."""
    kinds, sizes = {v: k for k, v in NODES.items()}, {v: k for k, v in CSS.items()}

    def leaves(n: dict) -> list[dict]:
        return [n] if n.get("type") in ("text", "hardBreak") else [x for c in n.get("content") or [] for x in leaves(c)]

    def inline(nodes: list[dict]) -> list[dict]:
        out: list[dict] = []
        for n in nodes:
            if n.get("type") == "hardBreak":
                out.append({"type": "hard_break"})
                continue
            marks = {m["type"]: m.get("attrs") or {} for m in n.get("marks") or []}
            look = {"marks": [m for m in MARKS if m in marks]} | ({"font_size": s} if (s := sizes.get(marks.get("textStyle", {}).get("fontSize"))) else {})
            for i, part in enumerate((n.get("text") or "").replace("\r", "").split("\n")):
                out += [{"type": "hard_break"}] if i else []
                if part and out and out[-1]["type"] == "text" and {**out[-1], "text": ""} == {"type": "text", "text": "", **look}:
                    out[-1]["text"] += part
                elif part:
                    out.append({"type": "text", "text": part, **look})
        return out

    def empty(at: str) -> dict:
        return {"id": issued(at), "type": "paragraph", "align": "left", "content": []}

    def block(n: dict, at: str) -> dict:
        attrs, kind = n.get("attrs") or {}, kinds.get(n.get("type"))
        own = {"id": attrs.get("blockId") or issued(at)}
        if kind in ("bullet_list", "ordered_list"):
            items = [(x.get("attrs") or {}, blocks(x.get("content"), f"{at}i/{j}b")) for j, x in enumerate(c for c in n.get("content") or [] if c.get("type") == "listItem")]
            if not items:
                return empty(at) | own
            out = own | {"type": kind, "items": [{"id": a.get("blockId") or issued(f"{at}i/{j}"), "blocks": b or [empty(f"{at}i/{j}b/0")]} for j, (a, b) in enumerate(items)]}
            return out | ({"start": attrs["start"] if isinstance(attrs.get("start"), int) else 1} if kind == "ordered_list" else {})
        if kind == "blockquote":
            return own | {"type": kind, "blocks": blocks(n.get("content"), at + "b") or [empty(at + "b/0")]}
        align = attrs.get("textAlign") if kind and attrs.get("textAlign") in ALIGNS else "left"
        level = {"level": min(MAX_LEVEL, max(1, attrs.get("level") or 1))} if kind == "heading" else {}
        return own | {"type": kind or "paragraph", "align": align, "content": inline(n.get("content") or [] if kind else leaves(n))} | level

    def blocks(nodes: list[dict] | None, path: str) -> list[dict]:
        return [block(n, f"{path}/{i}") for i, n in enumerate(nodes or [])]

    return {"schema_version": SCHEMA_VERSION, "title": (title or "Untitled")[:MAX_TITLE], "blocks": blocks(tree.get("content"), "")}


def editor_form(documents: DataFrame, key: str, content: str) -> DataFrame:
    """(key, form, kept): documents in the editor's format, and whether they come back from it unchanged (one without blocks doesn't: the editor
    needs a paragraph)."""

    def one(doc: dict) -> Iterator[tuple]:
        doc = normal(doc)
        form = to_editor(doc)
        yield json.dumps(form, ensure_ascii=False), canonical(from_editor(form, doc["title"])) == canonical(doc)

    return _each(documents, key, (content,), "form string, kept boolean", _valid(one))


def moved(blocks: DataFrame, key: str, at: str, moves: DataFrame) -> DataFrame:
    """blocks(key, at, ...) with top-level blocks moved one place: moves(key, at, direction: up or down) swaps a block with its neighbour; a move
    over the edge changes nothing. One move a document."""
    top = blocks.groupBy(key).agg(F.max(at).alias("_last"))
    target = F.col("_from") + F.when(F.col("direction") == "up", -1).otherwise(1)
    m = moves.select(key, F.col(at).alias("_from"), "direction").join(top, key).withColumn("_to", target).where((F.col("_to") >= 0) & (F.col("_to") <= F.col("_last")))
    placed = blocks.join(m.select(key, "_from", "_to"), key, "left")
    return placed.withColumn(at, F.when(F.col(at) == F.col("_from"), F.col("_to")).when(F.col(at) == F.col("_to"), F.col("_from")).otherwise(F.col(at))).select(*blocks.columns)


def reissued(blocks: DataFrame, key: str, at: str, own: str) -> DataFrame:
    """blocks with an id for those that have none or repeat an earlier one of their document: from document and place."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(key, own).orderBy(at))
    fresh = F.concat(F.lit("b"), F.left(F.sha1(F.concat_ws("/", F.col(key).cast("string"), F.col(at).cast("string"))), F.lit(10)))
    return blocks.withColumn(own, F.when((F.coalesce(own, F.lit("")) == "") | (n > 1), fresh).otherwise(F.col(own)))


class _Paste(HTMLParser):
    """Keeps tags and text, but for styling: u, ins, mark, font unwrapped, style, script, meta, link dropped, style and class attributes gone;
    bold and italic of inline styles become tags."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.ends: list[tuple[str, str]] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("style", "script"):
            self.skip += 1
        if self.skip or tag in ("meta", "link", "html", "body", "head"):
            return
        look = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(":") for x in (dict(attrs).get("style") or "").split(";"))}
        bold, italic = look.get("font-weight", "") in ("bold", "600", "700", "800", "900"), look.get("font-style") == "italic"
        plain_tag = tag in ("u", "ins", "mark", "font")
        kept = "" if plain_tag else "<" + tag + "".join(f' {k}="{v or ""}"' for k, v in attrs if k not in ("style", "class")) + ">"
        if plain_tag:
            bold = italic = False
        self.out.append(kept + "<strong>" * bold + "<em>" * italic)
        if tag not in ("br", "img", "hr", "input"):
            self.ends.append((tag, "</em>" * italic + "</strong>" * bold + ("" if plain_tag else f"</{tag}>")))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("style", "script"):
            self.skip = max(0, self.skip - 1)
        elif not self.skip and any(t == tag for t, _ in self.ends):
            while self.ends:
                t, end = self.ends.pop()
                self.out.append(end)
                if t == tag:
                    break

    def handle_data(self, data: str) -> None:
        self.out.append("" if self.skip else data)

    def handle_entityref(self, name: str) -> None:
        self.handle_data(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.handle_data(f"&#{name};")


def pasted(html: str | None) -> str | None:
    """HTML from outside as the editor takes it; from the editor's own clipboard as it is."""
    if not html or "data-pm-slice" in html:
        return html
    p = _Paste()
    p.feed(html)
    p.close()
    return "".join(p.out) + "".join(end for _, end in reversed(p.ends))


def pastes(rows: DataFrame, key: str, html: str) -> DataFrame:
    """(key, html) as pasted."""
    return _each(rows, key, (html,), "html string", lambda x: iter([(pasted(x),)]))


# Settings of a rendering with default and range (low, high, whole number).
RANGES = {
    "font_size": (16.0, 10, 28, False), "line_spacing": (1.6, 1.2, 3, False), "paragraph_spacing": (1, 0, 3, True), "margin_top_mm": (22.0, 5, 60, False), "margin_bottom_mm": (20.0, 5, 60, False),
    "margin_left_mm": (28.0, 5, 60, False), "margin_right_mm": (15.0, 5, 60, False), "variation": (1.0, 0, 2, False), "seed": (0, 0, 1_000_000, True),
}
CHOICES = {
    "style": "quick", "ink": "blue", "paper": "ruled", "page_size": "A4", "page_numbers": True, "page_number_position": "bottom", "header_name": "", "header_id": "", "underline_headings": False,
    "plain_headings": False, "show_through": False, "show_through_level": "medium", "pen_shadow": False, "watermark": False, "output": "scanned",
}
HEADER = 80


def single_line(text: Column) -> Column:
    """One printable line: runs of white space as a blank, control characters dropped."""
    blank = lambda t: F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    return blank(F.regexp_replace(blank(text), r"[\p{C}\p{Zl}\p{Zp}]+", ""))


def clean_setting(name: str, raw: Column) -> Column:
    """A setting from its JSON text: the default where it is missing or of another type, numbers in their range, headers cut to HEADER signs."""
    if name in RANGES:
        default, low, high, whole = RANGES[name]
        v = F.coalesce(raw.try_cast("double"), F.lit(float(default)))
        v = F.when(F.isnan(v) | (F.abs(v) > 1e300), F.lit(float(default))).otherwise(v)
        v = F.least(F.greatest(F.floor(v + 0.5).cast("double") if whole else v, F.lit(float(low))), F.lit(float(high)))
        return v.cast("long").cast("string") if whole else v.cast("string")
    if isinstance(CHOICES[name], bool):
        return F.when(raw.isin("true", "false"), raw).otherwise(F.lit(str(CHOICES[name]).lower()))
    held = F.coalesce(raw, F.lit(CHOICES[name]))
    return F.left(held, F.lit(HEADER)) if name.startswith("header_") else held


def settings(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, name, value): every setting of a JSON object of settings; unknown names are dropped."""
    names = sorted([*RANGES, *CHOICES])
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), clean_setting(n, F.get_json_object(raw, f"$.{n}")).alias("value")) for n in names])
    return rows.select(key, F.inline(pairs))


def settings_hash(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, settings_hash): sha256 of the settings in name order as JSON, with blanks behind commas and colons."""
    names = sorted([*RANGES, *CHOICES])
    quoted = lambda n: n in CHOICES and not isinstance(CHOICES[n], bool)
    parts = []
    for n in names:
        v = clean_setting(n, F.get_json_object(raw, f"$.{n}"))
        parts.append(F.concat(F.lit(f'"{n}": '), F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r'^\{"v":(.*)\}$', 1) if quoted(n) else v))
    return rows.select(key, F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256).alias("settings_hash"))
