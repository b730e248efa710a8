"""Problem 7: noise in text from scanned pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.languages import VOTES
from lectern.llm.languages import votes as votes_of
from lectern.runtime import small, stored

#: Signs that are read for a letter; inside of a word they can stand for nothing else.
SIGNS = {"0": "o", "1": "l", "5": "s", "6": "b", "9": "g", "@": "a", "!": "i"}
#: Letters read (left) for letters printed (right), or the other way round.
CONFUSIONS = [("c", "e"), ("f", "t"), ("b", "h"), ("rn", "m"), ("cl", "d"), ("ii", "u"), ("l", "i"), ("m", "in")]
#: A word is taken for what was printed if it stands so many times as often as the strange token. A place in a page that was not scanned
#: counts as so many in scanned lines.
RATIO = 2
#: Furniture has fewer other lines than this between itself and the top or bottom of its page.
EDGE = 2
#: A mark of the copy stands at the edge of pages of so many documents, and of its occurrences this share is at an edge.
MARKED, AT_EDGE = 2, 0.9

TOKEN = r"(?:!(?=\p{L})|[\p{L}\p{N}@])+"
BREAK = r"\p{L}[-¬\x{AD}‐]\s*$"
NUMBER = (
    r"(?i)^\W*(?:(?:p|pp|s|pag[ec]|pa9e|p@ge|pág|página|seite)\.?\s*)?[\dOolI]{1,4}(?:\s*(?:of|0f|o[ft]|/|von|sur|de)\s*[\dOolI]{1,4})?\W*$|^\W*[ivxlcI1!]{1,7}\W*$"
)


def skeleton(text: Column) -> Column:
    """A key that is the same for a text and its confusable misreadings: one letter for each class of confusable signs."""
    t = F.lower(text)
    for sign, letter in SIGNS.items():
        t = F.replace(t, F.lit(sign), F.lit(letter))
    t = F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")
    # single letters first, in the longer patterns too, so that equal stretches stay equal
    single = {m: s for s, m in CONFUSIONS if len(s) == len(m) == 1}
    for meant, seen in single.items():
        t = F.replace(t, F.lit(meant), F.lit(seen))
    for seen, meant in CONFUSIONS:
        if len(seen) + len(meant) > 2:
            longer, other = (seen, meant) if len(seen) > len(meant) else (meant, seen)
            as_one = lambda x: "".join(single.get(c, c) for c in x)
            t = F.replace(t, F.lit(as_one(longer)), F.lit(as_one(other)))
    return t


def anagram(word: Column) -> Column:
    """Sum of the fifth powers of the character codes: equal for the same letters in any order, so that a confusion is a difference."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda s, c: s + F.pow(F.pmod(F.ascii(c), F.lit(1024)).cast("double"), F.lit(5.0)).cast("long"))


def differences() -> list[tuple[int, int]]:
    """(difference, cost): what no or one confusion, either way round, adds to the anagram hash of the word read; least for one as listed."""
    value = lambda s: sum((ord(c) % 1024) ** 5 for c in s)
    return [(0, 0)] + [(sign * (value(m) - value(s)), cost) for s, m in CONFUSIONS for sign, cost in ((1, 2), (-1, 3))]


def plain_sign(token: Column) -> Column:
    t = F.lower(token)
    for sign, letter in SIGNS.items():
        t = F.replace(t, F.lit(sign), F.lit(letter))
    return t


def placed(ocr_lines: DataFrame) -> DataFrame:
    """(document_id, page, line_no, text, top, bottom, above, below): each line once, with its place from both ends of its page and the lines
    further out that can't be furniture. NULL keys are dropped."""
    one = ocr_lines.where("document_id is not null and page is not null and line_no is not null").groupBy("document_id", "page", "line_no").agg(F.coalesce(F.max("text"), F.lit("")).alias("text"))
    page = Window.partitionBy("document_id", "page")
    down = page.orderBy("line_no")
    body = (~(open_end(F.col("text")) | number(F.col("text")))).cast("int")
    out = one.withColumn("body", body).withColumn("top", F.row_number().over(down)).withColumn("above", F.sum("body").over(down) - F.col("body"))
    out = out.withColumn("bottom", F.count("*").over(page) - F.col("top") + 1).withColumn("below", F.sum("body").over(page) - F.col("above") - F.col("body"))
    return out.drop("body")


def open_end(text: Column) -> Column:
    """A short line that ends in no mark: what running heads, feet and copy marks look like."""
    return (F.length(F.trim(text)) < 70) & ~F.trim(text).rlike(r"[.,;:?!…\-¬\x{AD}‐]$")


def number(text: Column) -> Column:
    return (F.length(text) < 70) & F.trim(text).rlike(NUMBER)


def headless(text: Column) -> Column:
    """A running head without its page number."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s*[\dOolI]{1,4}\s*\|\s*", ""), r"(\s{2,}|\s*\|\s*)[\dOolI]{1,4}\s*$", "")


def furniture(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """(document_id, page, line_no) of page numbers, running heads and feet, and marks of the copy among the edge lines.

    A running head is, but for misread signs, the title of the document, one of its headings (lines that end in a colon), or the
    outermost line of another page of the document too. Furniture lies at the edge: at most EDGE - 1 lines further out are none, however many
    are. A copy mark ends in three words that close edge lines of several documents and hardly any
    line elsewhere.
    """
    bare = F.trim("text")
    end = F.array_join(F.slice(F.split(bare, r"\s+"), -3, 3), " ")
    cut = lines.withColumn("edge", (F.col("top") <= EDGE) | (F.col("bottom") <= EDGE)).withColumn("key", skeleton(headless(F.col("text"))))
    cut = cut.withColumn("suffix", F.when(F.size(F.split(bare, r"\s+")) >= 3, skeleton(end)))
    marks = cut.groupBy("suffix").agg(F.count_distinct(F.when(F.col("edge"), F.col("document_id"))).alias("docs"), F.avg(F.col("edge").cast("int")).alias("share")).where((F.col("docs") >= MARKED) & (F.col("share") >= AT_EDGE)).select("suffix").withColumn("mark", F.lit(True))
    heads = cut.where(bare.rlike(r":[\s~^_|=.,+\-/]*$") & (F.length(bare) < 70)).select("document_id", "key")
    named = titles.where("id is not null and title is not null").select(F.col("id").alias("document_id"), F.explode(F.array(skeleton(F.col("title")), skeleton(F.regexp_replace("title", r"\s+[-–(].*$", "")))).alias("key"))
    again = cut.where(((F.col("top") == 1) | (F.col("bottom") == 1)) & open_end(F.col("text"))).groupBy("document_id", "key").agg(F.count_distinct("page").alias("pages")).where("pages > 1").select("document_id", "key")
    known = heads.union(named).union(again).where(F.length("key") >= 4).distinct().withColumn("head", F.lit(True))
    edges = cut.where((F.col("above") < EDGE) | (F.col("below") < EDGE)).join(known, ["document_id", "key"], "left").join(small(marks, 60), "suffix", "left")
    mark = F.coalesce("mark", F.lit(False)) & (F.size(F.split(bare, r"\s+")) <= 8)
    likely = edges.where(number(F.col("text")) | open_end(F.col("text")) & (F.coalesce("head", F.lit(False)) | mark))
    page = Window.partitionBy("document_id", "page").orderBy("line_no")
    likely = likely.withColumn("above", F.col("top") - F.row_number().over(page)).withColumn("below", F.col("bottom") - 1 - F.count("*").over(page.rowsBetween(1, Window.unboundedFollowing)))
    return likely.where((F.col("above") < EDGE) | (F.col("below") < EDGE)).select("document_id", "page", "line_no")


def lexicon(pages: DataFrame) -> DataFrame:
    """(word, clean): how often each word, and each compound with its hyphen, stands in pages that were not scanned."""
    text = pages.where("source is null or source <> 'ocr'").groupBy("id").agg(F.max("text").alias("text"))
    both = F.concat(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)), F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+(?:-\p{L}+)+"), F.lit(0)))
    return text.select(F.explode(both).alias("word")).groupBy("word").agg(F.count("*").alias("clean"))


def corrections(tokens: DataFrame, lexicon_: DataFrame) -> DataFrame:
    """(token, meant): for every distinct token that no unscanned page holds the word it may be a misreading of: words of unscanned
    pages before words that stand in scanned lines alone, then the least confusions, then the most frequent.

    Signs count as the letters they are read for in the anagram hash. Tokens and words are joined on equal hashes after at most one confusion
    on either side, so two in all; the skeletons must agree, since an anagram alone says nothing about places. The word must
    stand RATIO times as often as the token.
    """
    seen = tokens.where(F.col("token").rlike(r"\p{L}") & (F.length("token") > 1)).select(F.lower("token").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    every = seen.join(lexicon_.select(F.col("word").alias("token"), "clean"), "token", "full").withColumn("plain", plain_sign(F.col("token")))
    every = stored(every.withColumn("av", anagram(F.col("plain"))).withColumn("skeleton", skeleton(F.col("plain"))), "evidence")
    weight = F.coalesce("clean", F.lit(0)) * RATIO + F.coalesce("n", F.lit(0))
    right = every.where(F.col("token").rlike(r"^[\p{L}-]+$") & (F.col("clean").isNotNull() | (F.col("n") >= RATIO)))
    right = right.select(F.col("token").alias("word"), weight.alias("weight"), F.col("clean").isNotNull().alias("sure"), "skeleton", "av")
    steps = lambda sign: F.inline(F.array(*[F.struct((F.col("av") + sign * d).alias("key"), F.lit(c).alias("cost")) for d, c in differences()]))
    left = every.where("clean is null").select("token", "n", "plain", "skeleton", steps(1))
    right = right.select("word", "weight", "sure", F.col("skeleton").alias("bone"), steps(-1)).withColumnRenamed("cost", "more")
    hit = left.join(right, "key").where((F.col("skeleton") == F.col("bone")) & (F.col("token") != F.col("word")) & (F.col("weight") >= F.col("n") * RATIO))
    cost = F.when(F.col("plain") == F.col("word"), 0).when(F.col("cost") + F.col("more") == 0, 6).otherwise(F.col("cost") + F.col("more"))
    best = hit.groupBy("token").agg(F.max(F.struct("sure", (-cost).alias("cost"), "weight", F.col("word").alias("meant"))).alias("x"))
    return best.select("token", F.col("x.meant").alias("meant"))


def english(pages: DataFrame) -> DataFrame:
    """(document_id) of documents whose function words are English in the first place."""
    w = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    votes = pages.where("document_id is not null").select("document_id", w.alias("w"))
    votes = votes.select("document_id", *[votes_of(F.col("w"), k).alias(k) for k in VOTES])
    total = votes.groupBy("document_id").agg(*[F.sum(k).alias(k) for k in VOTES])
    return total.where(F.col("en") > F.greatest("de", "es", "fr")).select("document_id")


def analysed(ocr_lines: DataFrame, pages: DataFrame, titles: DataFrame) -> DataFrame:
    """Every line (document_id, page, line_no, text) with furniture (boolean), hyphen (boolean), next_text, and fixes: array of (token, meant).

    hyphen: the line ends in a break mark and the next line of the body, maybe on the next page, goes on with letters, unless the
    unscanned pages hold the compound with its hyphen more often than the joined word.
    """
    lines = stored(placed(ocr_lines), "ocr-lines")
    off = stored(furniture(lines, titles), "furniture")
    words = stored(lexicon(pages), "lexicon")
    body = lines.join(off, ["document_id", "page", "line_no"], "left_anti")
    flow = Window.partitionBy("document_id").orderBy("page", "line_no")
    body = body.withColumn("next_text", F.lead("text").over(flow)).withColumn("next", F.struct(F.lead("page").over(flow).alias("page"), F.lead("line_no").over(flow).alias("line_no"))).withColumn("last_text", F.lag("text").over(flow))
    first = F.regexp_extract(F.regexp_replace(F.col("next_text"), r"^[^\p{L}\p{N}]+", ""), r"^" + TOKEN, 0)
    part = F.regexp_extract("text", r"([\p{L}\p{N}@]+(?:-[\p{L}]+)*)[-¬\x{AD}‐]\s*$", 1)
    body = body.withColumn("broken", F.col("text").rlike(BREAK) & (F.length(first) > 0)).withColumn("part", F.lower(part)).withColumn("rest", F.lower(first))
    body = stored(body.withColumn("after_break", F.coalesce(F.col("last_text").rlike(BREAK), F.lit(False))), "body")
    joined, compound = F.concat("part", "rest"), F.concat_ws("-", "part", "rest")
    ends = body.where("broken").select("document_id", "page", "line_no", joined.alias("joined"), compound.alias("compound"))
    a = words.select(F.col("word").alias("joined"), F.col("clean").alias("nj"))
    b = words.select(F.col("word").alias("compound"), F.col("clean").alias("nc"))
    kept = ends.join(a, "joined", "left").join(b, "compound", "left").where(F.coalesce("nc", F.lit(0)) > F.coalesce("nj", F.lit(0))).select("document_id", "page", "line_no", F.lit(True).alias("keeps"))
    # words inside of a line, without the parts of broken words; the joined word counts for each line that holds a wrong sign
    inner = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    inner = F.slice(inner, F.when(F.col("after_break"), 2).otherwise(1), F.greatest(F.size(inner) - F.col("after_break").cast("int") - F.col("broken").cast("int"), F.lit(0)))
    key = ["document_id", "page", "line_no"]
    spread = body.select(*key, F.explode(inner).alias("token")).withColumn("token", F.lower("token"))
    whole = body.where("broken").select(*key, "next", joined.alias("token"), "part", "rest")
    fix = stored(corrections(spread.select("token").union(whole.select("token")), words), "corrections")
    fixes = small(fix, 60)
    inside = spread.join(fixes, "token").select(*key, "token", "meant")
    # where the second part is right the first is what stands before it, where the first part is right the second is what is left
    sides = F.when(F.col("meant").startswith(F.col("part")), F.length("part")).otherwise(F.greatest(F.length("meant") - F.length("rest"), F.lit(1)))
    parted = whole.join(fixes, "token").withColumn("head", F.left("meant", sides)).withColumn("tail", F.expr("substring(meant, length(head) + 1)"))
    across = parted.where("head <> part").select(*key, F.col("part").alias("token"), F.col("head").alias("meant"))
    beyond = parted.where("tail <> rest").select("document_id", "next.page", "next.line_no", F.col("rest").alias("token"), F.col("tail").alias("meant"))
    all_ = inside.union(across).union(beyond).groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("token", "meant"))).alias("fixes"))
    out = lines.join(off.withColumn("furniture", F.lit(True)), key, "left").join(body.select(*key, "broken", "next_text"), key, "left").join(kept, key, "left").join(all_, key, "left")
    return out.select(*key, "text", F.coalesce("furniture", F.lit(False)).alias("furniture"), (F.coalesce("broken", F.lit(False)) & F.col("keeps").isNull()).alias("hyphen"), F.coalesce("keeps", F.lit(False)).alias("keeps"), "next_text", F.coalesce("fixes", F.array().cast("array<struct<token:string,meant:string>>")).alias("fixes"))


def found(ocr_lines: DataFrame, pages: DataFrame, titles: DataFrame) -> DataFrame:
    """(document_id, page, line_no, defect), a row a line and defect. Misread words count in English documents only; furniture has no other defect."""
    lines = analysed(ocr_lines, pages, titles)
    known = lines.join(english(pages).withColumn("en", F.lit(True)), "document_id", "left")
    named = F.when(F.col("furniture"), F.array(F.lit("furniture"))).otherwise(F.array_compact(F.array(F.when(F.col("hyphen"), "hyphen"), F.when((F.size("fixes") > 0) & F.col("en"), "misread"))))
    return known.select("document_id", "page", "line_no", F.explode(named).alias("defect"))


def repaired(ocr_lines: DataFrame, pages: DataFrame, titles: DataFrame) -> DataFrame:
    """(document_id, paragraphs, text): the body of each scanned document as running text, paragraphs apart by a blank line.

    Furniture goes, stray specks go, broken words are joined, corrections are put in. A line that ends a sentence and is clearly
    shorter than the page's longest ends its paragraph. A document of furniture alone has no row.
    """
    lines = analysed(ocr_lines, pages, titles).where("not furniture")
    clean = F.regexp_replace("text", r"(?<=^|\s)[~^_|=.:,+\-/]+(?=\s|$)\s*", "")
    # token by token, what stands between them as it is; a token's capitals stay
    parts = F.regexp_extract_all(clean, F.lit(f"(?s){TOKEN}|."), F.lit(0))
    put = lambda t: F.get(F.filter("fixes", lambda f: f["token"] == F.lower(t)), F.lit(0))["meant"]
    cased = lambda t, m: F.when((t == F.upper(t)) & (F.regexp_count(t, F.lit(r"\p{Lu}")) > 1), F.upper(m)).when(F.left(t, F.lit(1)).rlike(r"\p{Lu}"), F.initcap(m)).otherwise(m)
    right = F.when(F.size("fixes") == 0, clean).otherwise(F.array_join(F.transform(parts, lambda t: F.coalesce(cased(t, put(t)), t)), ""))
    width = F.max(F.length("text")).over(Window.partitionBy("document_id"))
    stop = F.col("text").rlike(r"[.!?:]\s*$") & (F.length("text") < 0.85 * width)
    glue = F.when(F.col("hyphen") | F.col("keeps"), "").when(stop, "\n\n").otherwise(" ")
    body = F.when(F.col("hyphen"), F.regexp_replace(right, r"[-¬\x{AD}‐]\s*$", "")).otherwise(F.trim(right))
    piece = F.struct("page", "line_no", F.concat(body, glue).alias("s"), stop.cast("int").alias("stop"))
    rows = lines.select("document_id", piece.alias("p"))
    return rows.groupBy("document_id").agg(F.array_sort(F.collect_list("p")).alias("p")).select("document_id", (F.aggregate("p", F.lit(0), lambda s, x: s + x["stop"]) + 1).alias("paragraphs"), F.trim(F.array_join(F.transform("p", lambda x: x["s"]), "")).alias("text"))
