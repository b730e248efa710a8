"""The queries that cover all operators over empty tables, and over tables of NULL rows, empty texts, very long texts, repeated rows and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from lectern.llm.queries import QUERIES

NAMES = "doc_specs segments uploaded_documents document_pages ocr_lines analyses chunks study_items documents eval_items source_targets split_targets".split()
LONG = " ".join(f"word{i % 997} and the {i % 89}th thing." for i in range(6_000))


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for n in NAMES:
        spark.read.parquet(f"{sf}/{n}.parquet").limit(0).write.parquet(f"{at}/{n}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    for n in NAMES:
        t = spark.read.parquet(f"{sf}/{n}.parquet").limit(30)
        nulls = t.limit(1).select(*[F.lit(None).cast(k).alias(c) for c, k in t.dtypes])
        texts = [c for c in ("text", "answer", "explanation", "question") if c in t.columns]
        blank = t.limit(4).withColumns({c: F.lit("") for c in texts})
        long = t.limit(2).withColumns({c: F.lit(LONG) for c in texts}) if texts else t.limit(0)
        gaps = t
        for i, (c, _) in enumerate(t.dtypes):
            gaps = gaps.withColumn(c, F.when(F.pmod(F.xxhash64(*t.columns), F.lit(len(t.columns))) != i, F.col(c)))
        every = t.union(t).union(nulls).union(blank).union(long).union(gaps)
        every.withColumns({c: F.lit("x") for c in ("h", "d", "n", "w", "x", "a", "b", "key", "rank", "node")}).write.parquet(f"{at}/{n}.parquet")
    return str(at)


@pytest.mark.parametrize("name", "p1_shares p1_forest p2_report p3_levels p4_found p5_groups p6_pieces p7_repaired p8_report p9_report p10_lines".split())
def test_empty_tables(spark, empty, name):
    df = QUERIES[name](spark, empty)
    assert df.count() == 0 or name in ("p9_report", "p1_shares")


@pytest.mark.parametrize("name", [q for q in QUERIES if q.endswith("_found")] + "p1_shares p2_report p5_groups p6_pieces p7_repaired p8_report p9_report".split())
def test_odd_tables(spark, odd, name):
    df = QUERIES[name](spark, odd)
    rows = df.collect()
    if name.endswith("_found"):
        assert all(r[0] is not None for r in rows) and len(rows) == len(set(rows))
