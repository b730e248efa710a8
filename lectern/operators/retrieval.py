"""Retrieval: lexical, dense and fused ranking, and extractive answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.runtime import small

#: BM25 constants; candidates a ranking gives to the fusion; fusion constant; results; least cosine that counts as evidence alone.
K1, B, EPSILON = 1.5, 0.75, 0.25
CANDIDATES, RRF, TOP, LEAST_DENSE = 20, 60, 5, 0.15
LEAST_OVERLAP = 0.34


def asked_chunks(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Chunks of the documents that questions name; nothing is exploded of others."""
    ids = questions.select("document_id").where("document_id is not null").distinct()
    return chunks.join(small(ids, 80), "document_id", "left_semi")


def bm25(chunks: DataFrame, questions: DataFrame, top: int = CANDIDATES) -> DataFrame:
    """(question_id, chunk_id, bm25, rank): chunks of the question's own document by BM25, scores above 0, best first, ties by chunk id.

    chunks(document_id, chunk_id, text); questions(question_id, document_id, question). The corpus of a question is its document;
    a negative idf becomes EPSILON times the document's mean idf. A term that a question repeats counts each time.
    """
    chunks = asked_chunks(chunks, questions)
    terms = chunks.select("document_id", "chunk_id", T.search_terms(F.col("text")).alias("w"))
    size = terms.groupBy("document_id").agg(F.count("*").alias("chunks"), F.avg(F.size("w").cast("double")).alias("avg_len"))
    tf = terms.select("document_id", "chunk_id", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("document_id", "chunk_id", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("document_id", "term").agg(F.count("*").alias("df")).join(size, "document_id")
    raw = F.ln(F.col("chunks") - F.col("df") + F.lit(0.5)) - F.ln(F.col("df") + F.lit(0.5))
    idf = df.withColumn("raw", raw)
    mean = idf.groupBy("document_id").agg(F.avg("raw").alias("mean"))
    idf = idf.join(mean, "document_id").withColumn("idf", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")))
    asked = questions.select("question_id", "document_id", F.explode(T.search_terms(F.col("question"))).alias("term")).groupBy("question_id", "document_id", "term").agg(F.count("*").alias("times"))
    hit = asked.join(idf, ["document_id", "term"]).join(tf, ["document_id", "term"])
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    score = hit.groupBy("question_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("bm25")).where("bm25 > 0")
    own = Window.partitionBy("question_id").orderBy(F.desc("bm25"), "chunk_id")
    return score.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def embed(rows: DataFrame, key: str, text: str, dim: int = 1024) -> DataFrame:
    """(key, place, value): sparse unit vectors over `dim` hashed places.

    Words and pairs of neighbouring words (function words left out) and the 3- to 5-character grams of padded words; a place holds
    2 ln(1 + words) + 0.5 ln(1 + grams). Grams are taken of the distinct words of a text, with their counts. The hash is Spark's
    own, so places differ from those of other hashing embedders. Texts without words have no place.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(dim)).cast("int")
    w = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    base = rows.select(key, w.alias("w")).withColumn("kept", F.filter("w", lambda x: ~T.is_stop(x)))
    n = F.greatest(F.size("kept") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("kept", 1, n), F.slice("kept", 2, n), lambda a, b: F.concat_ws(" ", a, b))
    whole = base.select(key, F.explode(F.concat("kept", pairs)).alias("t")).groupBy(key, place(F.col("t")).alias("place")).agg(F.count("*").alias("a"))
    each = base.select(key, F.explode("w").alias("t")).groupBy(key, "t").agg(F.count("*").alias("n")).withColumn("t", F.concat(F.lit(" "), "t", F.lit(" ")))
    cut = F.concat(*map(_grams, (3, 4, 5)))
    grams = each.select(key, "n", F.explode(cut).alias("g")).groupBy(key, place(F.col("g")).alias("place")).agg(F.sum("n").alias("b"))
    raw = whole.join(grams, [key, "place"], "full").select(key, "place", (2.0 * F.log1p(F.coalesce("a", F.lit(0))) + 0.5 * F.log1p(F.coalesce("b", F.lit(0)))).alias("x"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, key).select(key, "place", (F.col("x") / F.col("norm")).alias("value"))


def _grams(g: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") + 1 - g, F.lit(1))), lambda i: F.substr(F.col("t"), i, F.lit(g)))


def dense(chunks: DataFrame, questions: DataFrame, top: int = CANDIDATES) -> DataFrame:
    """(question_id, chunk_id, dense, rank): chunks of the question's document by cosine of hashed vectors."""
    chunks = asked_chunks(chunks, questions)
    q = embed(questions, "question_id", "question").join(questions.select("question_id", "document_id"), "question_id").withColumnRenamed("value", "a")
    c = embed(chunks, "chunk_id", "text").join(chunks.select("chunk_id", "document_id"), "chunk_id").withColumnRenamed("value", "b")
    score = q.join(c, ["document_id", "place"]).groupBy("question_id", "chunk_id").agg(F.round(F.sum(F.col("a") * F.col("b")), 6).alias("dense"))
    own = Window.partitionBy("question_id").orderBy(F.desc("dense"), "chunk_id")
    return score.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top)


def nearest(vectors: DataFrame, queries: DataFrame, top: int = CANDIDATES, block: int = 1000) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the nearest unit vectors of each query, itself left out, exact.

    The queries are a stated set; they come in blocks of `block` rows (of bounded size, broadcast) against all vectors, and the best
    of each partition are kept before the shuffle by the window's group limit.
    """
    n = queries.count()
    out = None
    for i in range(max(1, -(-n // block))):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // block)))) == i)
        pair = vectors.join(F.broadcast(part), F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(dot(F.col("embedding"), F.col("query")), 6).alias("cosine"))
        own = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
        best = pair.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top)
        out = best if out is None else out.unionByName(best)
    return out


def fuse(*rankings: DataFrame) -> DataFrame:
    """(question_id, chunk_id, score): reciprocal rank fusion of (question_id, chunk_id, rank) lists."""
    every = rankings[0].select("question_id", "chunk_id", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("question_id", "chunk_id", "rank"))
    return every.groupBy("question_id", "chunk_id").agg(F.round(F.sum(F.lit(1.0) / (RRF + F.col("rank"))), 6).alias("score"))


def retrieve(lexical: DataFrame, vectors: DataFrame, top: int = TOP) -> DataFrame:
    """(question_id, chunk_id, rank, score, dense, bm25): fused ranking behind the gate: without a lexical hit the best cosine must
    reach LEAST_DENSE. Ties go by dense rank, then lexical rank."""
    both = lexical.select("question_id", "chunk_id", "bm25", F.col("rank").alias("lr")).join(vectors.select("question_id", "chunk_id", "dense", F.col("rank").alias("dr")), ["question_id", "chunk_id"], "full")
    score = F.coalesce(1.0 / (RRF + F.col("dr")), F.lit(0.0)) + F.coalesce(1.0 / (RRF + F.col("lr")), F.lit(0.0))
    asked = Window.partitionBy("question_id")
    gate = F.max(F.col("lr").isNotNull()).over(asked) | (F.max(F.coalesce("dense", F.lit(0.0))).over(asked) >= LEAST_DENSE)
    kept = both.withColumn("score", F.round(score, 5)).withColumn("_gate", gate).where("_gate")
    own = asked.orderBy(F.desc("score"), F.col("dr").asc_nulls_last(), F.col("lr").asc_nulls_last(), "chunk_id")
    return kept.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top).select("question_id", "chunk_id", "rank", "score", F.round(F.coalesce("dense", F.lit(0.0)), 4).alias("dense"), F.round(F.coalesce("bm25", F.lit(0.0)), 4).alias("bm25"))


def answer_units(text: Column) -> Column:
    """Sentences, parts of fewer than five words joined to the unit before."""
    few = lambda x: F.size(T.pieces(x)) < 5
    last = lambda a: F.element_at(a, -1)
    return F.aggregate(T.sentences(text), F.array().cast("array<string>"), lambda a, s: F.when(F.size(a) == 0, F.array(s)).when(
        few(s) | few(F.try_element_at(a, F.lit(-1))), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(a, F.lit(-1)), s)))).otherwise(F.concat(a, F.array(s))))


def answers(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(question_id, answer, citations, confidence): at most two of the three best sentences of the retrieved chunks.

    retrieved(question_id, chunk_id, rank, text). Sentences are scored by the idf-weighted share of the question's stemmed content
    words; a sentence that ends in a question mark is no candidate. Below LEAST_OVERLAP the answer is NULL.
    """
    stems = lambda c: F.array_distinct(F.transform(T.content_words(c), T.stem))
    asked = questions.select("question_id", stems(F.col("question")).alias("q")).where(F.size("q") > 0)
    units = retrieved.select("question_id", "chunk_id", "rank", F.posexplode(answer_units(F.col("text"))).alias("pos", "unit")).withColumn("w", stems(F.col("unit"))).where(~F.rtrim("unit").endswith("?") & (F.size("w") > 0))
    n = units.groupBy("question_id").agg(F.count("*").alias("n"))
    words = asked.select("question_id", F.explode("q").alias("word"))
    df = units.select("question_id", F.explode("w").alias("word")).groupBy("question_id", "word").agg(F.count("*").alias("df"))
    idf = words.join(n, "question_id").join(df, ["question_id", "word"], "left").withColumn("idf", F.ln(1 + F.col("n") / (1 + F.coalesce("df", F.lit(0)))))
    total = idf.groupBy("question_id").agg(F.sum("idf").alias("total"))
    key = ["question_id", "rank", "pos"]
    got = units.select(*key, F.explode("w").alias("word")).join(idf, ["question_id", "word"]).groupBy(*key).agg(F.sum("idf").alias("got"))
    scored = units.join(got, key, "left").join(total, "question_id").withColumn("overlap", F.round(F.coalesce("got", F.lit(0.0)) / F.col("total"), 6))
    own = Window.partitionBy("question_id").orderBy(F.desc("overlap"), "rank", "pos")
    ranked = scored.withColumn("i", F.row_number().over(own)).withColumn("top", F.max("overlap").over(Window.partitionBy("question_id"))).where("i <= 3")
    good = ranked.where((F.col("top") >= LEAST_OVERLAP) & (F.col("overlap") >= F.greatest(F.lit(LEAST_OVERLAP), 0.75 * F.col("top"))) & (F.col("i") <= 2))
    said = good.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("i", "unit", "chunk_id"))).alias("l"), F.max("top").alias("top"))
    out = questions.select("question_id").join(said, "question_id", "left")
    level = F.when(F.col("top") >= 0.6, "high").when(F.col("top") >= 0.45, "medium").otherwise("low")
    return out.select("question_id", F.array_join(F.transform("l", lambda x: x["unit"]), " ").alias("answer"), F.array_join(F.array_distinct(F.transform("l", lambda x: x["chunk_id"])), ",").alias("citations"), level.alias("confidence"))


def aliases(retrieved: DataFrame) -> DataFrame:
    """retrieved(question_id, chunk_id, rank) with `alias`: c1, c2, ... by rank."""
    n = F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "chunk_id"))
    return retrieved.withColumn("alias", F.concat(F.lit("c"), n.cast("string")))


def cited(answers_: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(question_id, answer, chunk_ids, grounded): of answers(question_id, answer, citations array of aliases) the citations that name a retrieved
    chunk, as chunk ids in order; an answer without any is NULL."""
    known = aliases(retrieved).groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("alias", F.col("chunk_id").cast("string")))).alias("m"))
    ids = F.filter(F.transform("citations", lambda c: F.try_element_at("m", c)), lambda x: x.isNotNull())
    rows = answers_.join(known, "question_id", "left").withColumn("ids", F.coalesce(ids, F.array().cast("array<string>")))
    good = F.col("answer").isNotNull() & (F.col("answer") != "") & (F.size("ids") > 0)
    return rows.select("question_id", F.when(good, F.col("answer")).alias("answer"), F.array_join(F.when(good, F.col("ids")).otherwise(F.array().cast("array<string>")), ",").alias("chunk_ids"), good.alias("grounded"))


def retrieval_metrics(asked: DataFrame, retrieved: DataFrame, answered: DataFrame) -> DataFrame:
    """One row: n_questions, n_answerable, recall_at_1, recall_at_5, mrr, evidence_rate, refusal_rate, false_refusals.

    asked(question_id, evidence): NULL evidence means that the question can't be answered. The rank of a question is that of the first retrieved chunk
    (question_id, rank, text) that holds the evidence, case ignored. evidence_rate: answerable questions whose answer holds it;
    refusal_rate: unanswerable ones without an answer; false_refusals: answerable ones without.
    """
    has = lambda text: F.contains(F.lower(text), F.lower("evidence"))
    hit = retrieved.join(asked.where("evidence is not null"), "question_id").where(has(F.col("text"))).groupBy("question_id").agg(F.min("rank").alias("rank"))
    rows = asked.join(hit, "question_id", "left").join(answered.select("question_id", "answer"), "question_id", "left")
    can, refused = F.col("evidence").isNotNull(), F.col("answer").isNull()
    share = lambda x, of: F.round(F.avg(F.when(of, F.coalesce(x.cast("double"), F.lit(0.0)))), 4)
    return rows.agg(
        F.count("*").alias("n_questions"), F.count_if(can).alias("n_answerable"), share(F.col("rank") == 1, can).alias("recall_at_1"), share((F.col("rank") <= TOP), can).alias("recall_at_5"),
        share(1.0 / F.col("rank"), can).alias("mrr"), share(has(F.col("answer")), can).alias("evidence_rate"), share(refused, ~can).alias("refusal_rate"), F.count_if(can & refused).alias("false_refusals"))
