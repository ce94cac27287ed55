"""Queries of the operators in this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithline.llm import chunking, leakage, merkle, mixture, quota, softlogic, splits, tokens, variants

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    side = lambda i: (f"first_name{i}", f"last_name{i}", f"middle_name{i}")
    return variants.link_variants(_t(spark, d, "ml_data"), key="pair_id", left=side(1), right=side(2)).select("pair_id")


def p1_variants(spark: SparkSession, d: str) -> DataFrame:
    """All rows whose sides mean the same, also those that differ only in case, blanks and punctuation, with their similarity."""
    side = lambda i: (f"first_name{i}", f"last_name{i}", f"middle_name{i}")
    return variants.link_variants(_t(spark, d, "ml_data"), key="pair_id", left=side(1), right=side(2), variants_only=False)


def _sample(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return quota.sample_to_targets(_t(spark, d, "ml_data_rvw"), _t(spark, d, "category_targets"), key="review_id", stratum=F.date_trunc("quarter", "reviewed_at"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Categories that lack the rows for their minimum or their share of the sample."""
    return _sample(spark, d)[1].where("below_min or below_share").select("category")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[0].select("review_id", "category", "reviewed_at")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[1]


def p2_available(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[1].select("category", "min_rows", "available", "below_min", "below_share")


def _copies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return merkle.collapse_copies(_t(spark, d, "ml_data"), key="pair_id", exact=["phone_number", "first_name2", "middle_name2", "last_name2"], free=["first_name1", "middle_name1", "last_name1"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d)[1]


def p4_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d)[0]


def _matched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return softlogic.match_rows([_t(spark, d, f"name{i}") for i in (1, 2, 3)])


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches of representatives, with what the coupling rules changed."""
    return _matched(spark, d)[0]


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its representative and the number of that one's matches."""
    return _matched(spark, d)[1].select(F.col("id").alias("name_id"), F.col("rid").alias("representative"), "n_links")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return softlogic.match_entities([_t(spark, d, f"name{i}") for i in (1, 2, 3)]).select("name_id_a", "name_id_b")


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return splits.split_components(_t(spark, d, "ml_data_rvw"), _t(spark, d, "split_targets"), component="phone_number", row_key="review_id", label="category")


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d)[0].select("review_id", "phone_number", "category", "split")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d)[1]


def p6_components(spark: SparkSession, d: str) -> DataFrame:
    """Splits that each phone number's rows stand in."""
    return _split(spark, d)[0].where("phone_number is not null").groupBy("phone_number").agg(F.count_distinct("split").alias("n_splits"))


def p6_labels(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each label over all splits."""
    return _split(spark, d)[1].groupBy("label").agg(F.sum("n_rows").alias("n_rows"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items")).select("item_id", "doc_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p7_pages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(leakage.find_leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items")))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixture.mix_sources(_t(spark, d, "documents"), _t(spark, d, "source_targets"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that each source has, and whether the mixture keeps to them, to the repeats and to shares that sum to 1."""
    every = F.sum("actual_share").over(Window.partitionBy(F.lit(1)))  # one row per source
    kept = (F.col("used_documents") <= F.col("n_documents")) & (F.col("copies") <= F.col("used_documents") * F.col("max_repeats")) & (F.abs(every - 1) < 1e-9)
    return _mix(spark, d)[1].select("source", "n_documents", kept.alias("kept"))


def _mix_large(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A mixture of as many tokens as the listed sources have; those that are too small for their share are exhausted."""
    listed = _t(spark, d, "source_targets").select("source")
    size = _t(spark, d, "documents").join(F.broadcast(listed), "source").agg(F.sum(tokens.token_count("text"))).first()[0] or 0
    return mixture.mix_sources(_t(spark, d, "documents"), _t(spark, d, "source_targets"), total_tokens=size)


def p8_large(spark: SparkSession, d: str) -> DataFrame:
    return _mix_large(spark, d)[0]


def p8_large_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix_large(spark, d)[1]


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_documents(_t(spark, d, "documents"), _t(spark, d, "piece_limits"))


def queries() -> dict[str, Query]:
    listed = [p1_found, p1_variants, p2_found, p2_sample, p2_report, p2_available, p4_found, p4_collapsed, p5_found, p5_matches, p5_members, p6_splits, p6_report, p6_components, p6_labels, p7_found, p7_leaks, p7_pages, p8_mixture, p8_report, p8_documents, p8_large, p8_large_report, p9_pieces]
    return {f.__name__: f for f in listed}


_LETTERS = "nullif(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '')"
_FREE = "list_sort(list_filter([" + ", ".join(_LETTERS.format(c) for c in ("first_name1", "middle_name1", "last_name1")) + "], lambda x: x is not null))"
_COPY = f"phone_number, first_name2, middle_name2, last_name2, {_FREE}"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
            WITH n AS (SELECT count(*) // 3 AS n FROM ml_data_rvw WHERE category IS NOT NULL), h AS (SELECT category, count(*) AS k FROM ml_data_rvw GROUP BY category)
            SELECT t.category FROM category_targets t LEFT JOIN h ON h.category = t.category, n WHERE coalesce(k, 0) < t.min_rows OR coalesce(k, 0) < t.target_share * n.n""",
        "p2_available": """
            WITH n AS (SELECT count(*) // 3 AS n FROM ml_data_rvw WHERE category IS NOT NULL), h AS (SELECT category, count(*) AS k FROM ml_data_rvw GROUP BY category)
            SELECT t.category, min_rows, coalesce(k, 0) AS available, coalesce(k, 0) < min_rows AS below_min, coalesce(k, 0) < target_share * n AS below_share FROM category_targets t LEFT JOIN h ON h.category = t.category, n""",
        "p6_components": "SELECT phone_number, 1 AS n_splits FROM ml_data_rvw WHERE phone_number IS NOT NULL GROUP BY 1",
        "p6_labels": "SELECT coalesce(category, 'no label') AS label, count(*) AS n_rows FROM ml_data_rvw GROUP BY 1 UNION ALL SELECT 'all rows', count(*) FROM ml_data_rvw",
        "p8_documents": "SELECT source, count(doc_id) AS n_documents, true AS kept FROM source_targets LEFT JOIN (SELECT source, doc_id FROM documents WHERE text <> '') USING (source) GROUP BY 1",
        "p4_found": f"SELECT * FROM (SELECT min(pair_id) OVER (PARTITION BY {_COPY}) AS pair_id_a, pair_id AS pair_id_b FROM ml_data) WHERE pair_id_a <> pair_id_b",
        "p4_collapsed": f"SELECT min(pair_id) AS pair_id, count(*) AS n_copies FROM ml_data GROUP BY {_COPY}",
    }
