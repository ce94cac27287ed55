"""The catalogue of queries over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithline.functions import distance as D
from kithline.functions import text
from kithline.operators import evaluate, features, pairs, prepare, reshape, sampling, skew
from kithline.plans import pipeline
from kithline.plans.model import GRIDS, NameMatcher

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that has the same result."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _names(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, f"name{i}").select("name_id", "phone_number", "first_name", "middle_name", "last_name", F.lit(i).alias("feed")) for i in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT phone_number FROM ml_data WHERE phone_number IS NOT NULL GROUP BY phone_number HAVING count(*) * 50 >= (SELECT count(*) FROM ml_data)")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of ml_data for each number of the directory of all phones, one row per number, by eager aggregation on both sides of the join."""
    ml = table(spark, d, "ml_data")
    directory = _names(spark, d).select("phone_number").unionByName(ml.select("phone_number")).distinct()
    per_phone = skew.eager_join_aggregate(ml, directory, "phone_number", {}, {}, how="inner")
    total = ml.agg(F.count(F.lit(1)).alias("total"))
    return per_phone.join(F.broadcast(total), F.col("join_rows") * 50 >= F.col("total")).select("phone_number")


@query("""
    WITH m AS (SELECT phone_number, count(*) AS n, sum(keep) AS k FROM ml_data WHERE phone_number IS NOT NULL GROUP BY 1),
    a AS (SELECT phone_number, count(*) AS n FROM (SELECT DISTINCT phone_number, first_name1, middle_name1, last_name1 FROM ml_data) GROUP BY 1),
    b AS (SELECT phone_number, count(*) AS n FROM (SELECT DISTINCT phone_number, first_name2, middle_name2, last_name2 FROM ml_data) GROUP BY 1),
    c AS (SELECT phone_number, count(*) AS n FROM (SELECT DISTINCT phone_number, first_name1, middle_name1, last_name1, first_name2, middle_name2, last_name2 FROM ml_data) GROUP BY 1),
    r AS (SELECT phone_number, count(*) AS n FROM (SELECT phone_number FROM name1 UNION ALL SELECT phone_number FROM name2 UNION ALL SELECT phone_number FROM name3) GROUP BY 1)
    SELECT m.phone_number, m.n AS n_rows, m.k AS n_kept, a.n AS distinct_names1, b.n AS distinct_names2, c.n AS distinct_pairs, coalesce(r.n, 0) AS name_rows, m.n * coalesce(r.n, 0) AS joined_rows, m.k * coalesce(r.n, 0) AS joined_kept
    FROM m JOIN a USING (phone_number) JOIN b USING (phone_number) JOIN c USING (phone_number) LEFT JOIN r USING (phone_number)""")
def p3_per_phone(spark: SparkSession, d: str) -> DataFrame:
    ml = table(spark, d, "ml_data")
    joined = skew.eager_join_aggregate(ml, _names(spark, d), "phone_number", {"n_kept": F.col("keep").cast("long")}, {})
    sides = [[f"{p}_name{i}" for p in ("first", "middle", "last")] for i in (1, 2)]
    sets = skew.distinct_per_key(ml, "phone_number", {"distinct_names1": sides[0], "distinct_names2": sides[1], "distinct_pairs": sides[0] + sides[1]})
    return joined.join(sets, "phone_number").select("phone_number", F.col("left_rows").alias("n_rows"), "n_kept", "distinct_names1", "distinct_names2", "distinct_pairs", F.col("right_rows").alias("name_rows"), F.col("join_rows").alias("joined_rows"), F.col("n_kept_joined").alias("joined_kept"))


# --- names and pairs ---

_SIX = [f"{p}_name{i}" for p in ("first", "middle", "last") for i in (1, 2)]


#: The letters beyond ASCII in the test tables, in place of which the SQL has control characters where an engine counts bytes.
_WIDE = {"\u00a0": 1, "\u2010": 2, "\u2019": 3}


def _pairs(spark: SparkSession, d: str, name: str = "ml_data") -> DataFrame:
    """Pairs with names in lower case, otherwise as they stand."""
    return table(spark, d, name).withColumns({c: F.lower(c) for c in _SIX})


def _pairs_sql(name: str = "ml_data", *, coded: bool = True) -> str:
    """The same in SQL; coded: each wide letter is one byte, which keeps all distances."""
    wide, narrow = "||".join(f"chr({ord(c)})" for c in _WIDE), "||".join(f"chr({n})" for n in _WIDE.values())
    return f"(SELECT * REPLACE ({', '.join(f'translate(lower({c}), {wide}, {narrow}) AS {c}' if coded else f'lower({c}) AS {c}' for c in _SIX)}) FROM {name})"


_SCORED = f"""(SELECT *, round_even(1 - d1 / nullif(n1, 0)::DOUBLE, 1) AS str_dist1, round_even(1 - d2 / nullif(n2, 0)::DOUBLE, 1) AS str_dist2, round_even(1 - (d1 + d2) / nullif(n1 + n2, 0)::DOUBLE, 1) AS str_dist_all
    FROM (SELECT *, levenshtein(first_name1, first_name2) AS d1, levenshtein(last_name1, last_name2) AS d2, greatest(length(first_name1), length(first_name2)) AS n1, greatest(length(last_name1), length(last_name2)) AS n2 FROM {_pairs_sql()}))"""


@query(f"SELECT str_dist_all, count(*) AS n_pairs FROM {_SCORED} GROUP BY 1")
def pair_tier_counts(spark: SparkSession, d: str) -> DataFrame:
    return pairs.edit_scores(_pairs(spark, d)).groupBy("str_dist_all").agg(F.count(F.lit(1)).alias("n_pairs"))


@query(f"SELECT pair_id, str_dist1, str_dist2, str_dist_all FROM {_SCORED}")
def pair_edit_scores(spark: SparkSession, d: str) -> DataFrame:
    return pairs.edit_scores(_pairs(spark, d)).select("pair_id", "str_dist1", "str_dist2", "str_dist_all")


def _distinct(spark: SparkSession, d: str, i: int) -> DataFrame:
    return pairs.distinct_names(table(spark, d, f"name{i}"))


def _join_sql(a: int, b: int) -> str:
    side = lambda i: f"(SELECT DISTINCT phone_number, lower(first_name) AS f, lower(middle_name) AS m, lower(last_name) AS l FROM name{i} WHERE first_name IS NOT NULL AND last_name IS NOT NULL)"
    return f"SELECT x.phone_number, x.f AS first_name1, x.m AS middle_name1, x.l AS last_name1, y.f AS first_name2, y.m AS middle_name2, y.l AS last_name2 FROM {side(a)} x JOIN {side(b)} y ON x.phone_number = y.phone_number"


@query(" UNION ALL ".join(_join_sql(a, b) for a, b in ((1, 2), (1, 3), (2, 3))))
def pairs_cross_files(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pairs_among([pairs.usable_names(table(spark, d, f"name{i}")) for i in (1, 2, 3)], [(0, 1), (0, 2), (1, 2)], distinct=True)


@query(" UNION ALL ".join(_join_sql(a, a) for a in (1, 2)))
def pairs_within_file(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pairs_among([pairs.usable_names(table(spark, d, f"name{i}")) for i in (1, 2)], [(0, 0), (1, 1)], distinct=True)


@query(f"SELECT phone_number, count(*) AS n_pairs FROM ({' UNION ALL '.join(_join_sql(a, b) for a, b in ((1, 2), (1, 3), (2, 3), (1, 1), (2, 2)))}) GROUP BY 1")
def pairs_union_all(spark: SparkSession, d: str) -> DataFrame:
    n = {i: _distinct(spark, d, i) for i in (1, 2, 3)}
    return pairs.all_pairs(n[1], n[2], n[3]).groupBy("phone_number").agg(F.count(F.lit(1)).alias("n_pairs"))


@query("""WITH a AS (SELECT DISTINCT phone_number, lower(first_name) AS first_name, lower(middle_name) AS middle_name, lower(last_name) AS last_name FROM name1 WHERE first_name IS NOT NULL AND last_name IS NOT NULL),
    b AS (SELECT phone_number, count(*) AS n FROM (SELECT DISTINCT phone_number, lower(first_name), lower(middle_name), lower(last_name) FROM name2 WHERE first_name IS NOT NULL AND last_name IS NOT NULL) GROUP BY 1)
    SELECT a.*, coalesce(n, 0) AS n_links FROM a LEFT JOIN b ON a.phone_number = b.phone_number""")
def pairs_links(spark: SparkSession, d: str) -> DataFrame:
    """One row per name of the first file with the number of its partners in the second."""
    return pairs.link_counts(_distinct(spark, d, 1), _distinct(spark, d, 2))


_NA_SQL = "CASE WHEN {0} IN ('', ' ', '  ', '-', 'NULL', 'NA', '''na') THEN NULL ELSE {0} END AS {0}"
_EXP = ["primary_key", "primary_phone", "match_code", "first_name", "last_name", "middle_initial"]


@query(f"SELECT {', '.join(_NA_SQL.format(c) for c in _EXP)} FROM feed_exp")
def null_tokens(spark: SparkSession, d: str) -> DataFrame:
    return text.null_tokens(table(spark, d, "feed_exp"))


@query(f"SELECT * FROM (SELECT {', '.join(_NA_SQL.format(c) for c in _EXP)} FROM feed_exp) WHERE first_name IS NOT NULL OR middle_initial IS NOT NULL")
def any_not_null(spark: SparkSession, d: str) -> DataFrame:
    return reshape.drop_all_null(text.null_tokens(table(spark, d, "feed_exp")), ["first_name", "middle_initial"])


@query(f"""SELECT DISTINCT try_cast(regexp_replace(primary_phone, '[^0-9]', '', 'g') AS BIGINT) AS phone_number, regexp_replace(lower(first_name), '^\\s+|\\s+$', '', 'g') AS first_name, regexp_replace(lower(middle_initial), '^\\s+|\\s+$', '', 'g') AS middle_name, regexp_replace(lower(last_name), '^\\s+|\\s+$', '', 'g') AS last_name
    FROM (SELECT {', '.join(_NA_SQL.format(c) for c in _EXP)} FROM feed_exp) WHERE first_name IS NOT NULL AND last_name IS NOT NULL""")
def names_clean_distinct(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.clean_exp(table(spark, d, "feed_exp"))


_SUBJECTS = {f"subject{i}": {"first_name": f"first_name{i}", "middle_name": f"middle_name{i}", "last_name": f"last_name{i}"} for i in (1, 2)}


@query(" UNION ALL ".join(f"SELECT pair_id, phone_number, 'subject{i}' AS tu_subject, first_name{i} AS first_name, middle_name{i} AS middle_name, last_name{i} AS last_name FROM ml_data WHERE coalesce(first_name{i}, middle_name{i}, last_name{i}) IS NOT NULL" for i in (1, 2)))
def unpivot_subjects(spark: SparkSession, d: str) -> DataFrame:
    return reshape.unpivot_groups(table(spark, d, "ml_data"), ["pair_id", "phone_number"], _SUBJECTS, "tu_subject")


@query(" UNION ALL ".join(f"SELECT pair_id, 'phone_listing{i}' AS mcr_ord, middle_name{i} AS middle_name, {'keep' if i == 1 else 'NULL'} AS status FROM ml_data WHERE middle_name{i} IS NOT NULL" for i in (1, 2)))
def unpivot_listings(spark: SparkSession, d: str) -> DataFrame:
    groups = {f"phone_listing{i}": {"middle_name": f"middle_name{i}"} | ({"status": "keep"} if i == 1 else {}) for i in (1, 2)}
    return reshape.unpivot_groups(table(spark, d, "ml_data"), ["pair_id"], groups, "mcr_ord", ["middle_name"])


@query(" UNION ALL ".join(f"SELECT pair_id, 'subject{i}' AS tu_subject, 'address{a}' AS tu_address, first_name{i} AS first_name, last_name{i} AS last_name, {('CAST(phone_number AS VARCHAR)' if a == 1 else f'middle_name{i}')} AS full_address FROM ml_data WHERE coalesce(first_name{i}, last_name{i}, {('CAST(phone_number AS VARCHAR)' if a == 1 else f'middle_name{i}')}) IS NOT NULL" for i in (1, 2) for a in (1, 2)))
def unpivot_subject_addresses(spark: SparkSession, d: str) -> DataFrame:
    wide = {f"subject{i}_name_{p}_name": F.col(f"{p}_name{i}") for i in (1, 2) for p in ("first", "last")}
    wide |= {f"subject{i}_address{a}_full_address": F.col("phone_number").cast("string") if a == 1 else F.col(f"middle_name{i}") for i in (1, 2) for a in (1, 2)}
    t = table(spark, d, "ml_data").select("pair_id", *[c.alias(n) for n, c in wide.items()])
    return reshape.unpivot_groups(t, ["pair_id"], reshape.subject_addresses(t.columns), ["tu_subject", "tu_address"])


_ADDRESSES = """(SELECT phone_number, first_name, last_name, 1 + name_id % 2 AS tu_subject, 1 + name_id % 3 AS tu_address, CASE WHEN first_seen IS NULL OR name_id % 4 = 0 THEN NULL ELSE 'since ' || year(first_seen) END AS full_address, CAST(last_seen AS VARCHAR) AS date_last_seen FROM name2)"""


@query(f"""WITH t AS {_ADDRESSES}, r AS (SELECT DISTINCT phone_number, first_name, last_name, tu_subject, full_address, date_last_seen FROM t),
    s AS (SELECT phone_number, first_name, last_name, tu_subject FROM r GROUP BY ALL HAVING count(*) = 1),
    n AS (SELECT *, string_agg(tu_subject, ', ' ORDER BY tu_subject) OVER (PARTITION BY phone_number, first_name, last_name ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM s),
    j AS (SELECT t.*, n.l FROM t LEFT JOIN n ON t.phone_number IS NOT DISTINCT FROM n.phone_number AND t.first_name IS NOT DISTINCT FROM n.first_name AND t.last_name IS NOT DISTINCT FROM n.last_name AND t.tu_subject = n.tu_subject)
    SELECT * FROM (SELECT DISTINCT phone_number, first_name, last_name, 'tu_subject' || coalesce(l, tu_subject::VARCHAR) AS tu_subject, 'tu_address' || CASE WHEN l IS NULL THEN tu_address::VARCHAR ELSE '1-10' END AS tu_address,
    CASE WHEN l IS NULL THEN full_address ELSE '**No Address Information Provided for this Phone Number and Name**' END AS full_address, date_last_seen FROM j) WHERE full_address IS NOT NULL OR date_last_seen IS NOT NULL""")
def address_sentinel(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "name2").select(
        "phone_number", "first_name", "last_name", (1 + F.col("name_id") % 2).alias("tu_subject"), (1 + F.col("name_id") % 3).alias("tu_address"),
        F.when(F.col("first_seen").isNotNull() & (F.col("name_id") % 4 != 0), F.concat(F.lit("since "), F.year("first_seen").cast("string"))).alias("full_address"), F.col("last_seen").cast("string").alias("date_last_seen"),
    )
    return reshape.address_sentinel(t, ["phone_number", "first_name", "last_name"], "tu_subject", "tu_address", ["full_address", "date_last_seen"])


_CLEAN_NAME = "regexp_replace(lower({0}), '^\\s+|\\s+$', '', 'g')"


def _names_sql(source: str) -> str:
    """Distinct names of both sides of the pairs, without the texts that stand for a missing value."""
    given = lambda c: _NA_SQL.format(c).rsplit(" AS ", 1)[0]
    each = " UNION ALL ".join(f"SELECT phone_number, {given(f'first_name{i}')} AS f, {given(f'middle_name{i}')} AS m, {given(f'last_name{i}')} AS l FROM {source}" for i in (1, 2))
    return f"SELECT DISTINCT phone_number, {_CLEAN_NAME.format('f')} AS first_name, {_CLEAN_NAME.format('m')} AS middle_name, {_CLEAN_NAME.format('l')} AS last_name FROM ({each}) WHERE f IS NOT NULL AND l IS NOT NULL"


@query(_names_sql("ml_data"))
def names_clean_mcr(spark: SparkSession, d: str) -> DataFrame:
    """A raw feed of listings with camel-case headers and an apostrophe before each phone, from raw columns to names."""
    t = table(spark, d, "ml_data")
    wide = {f"iPhoneListing{i}{p.title()}Name": F.col(f"{p}_name{i}") for i in (1, 2) for p in ("first", "middle", "last")} | {"iPhoneListing1LastSeen": F.date_format("made_at", "MM/dd/yyyy"), "iPhoneListing2City": F.lit("-")}
    return pipeline.clean_mcr(t.select(F.col("pair_id").cast("string").alias("iKey"), F.concat(F.lit("'"), F.col("phone_number").cast("string")).alias("iPhone"), *[c.alias(n) for n, c in wide.items()]))


@query(_names_sql("ml_data"))
def names_clean_tu(spark: SparkSession, d: str) -> DataFrame:
    """A raw feed of subjects with addresses, from raw columns to names."""
    t = table(spark, d, "ml_data")
    wide = {f"TloSubject{i}Name{p.title()}Name": F.col(f"{p}_name{i}") for i in (1, 2) for p in ("first", "middle", "last")}
    wide |= {f"TloSubject{i}Address{a}FullAddress": F.lit("NULL") if a == 2 else F.col("phone_number").cast("string") for i in (1, 2) for a in (1, 2)} | {"TloSubject1Address1DateFirstSeen": F.date_format("made_at", "MM/dd/yyyy")}
    return pipeline.clean_tu(t.select(F.col("phone_number").cast("string").alias("Phonenumber"), *[c.alias(n) for n, c in wide.items()]))


@query("""SELECT doc_id, CAST(try_strptime(t, '%m/%d/%Y') AS DATE) AS parsed FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'n/a' WHEN doc_id % 11 = 0 THEN '13/45/1890' ELSE strftime(issue_date, '%m/%d/%Y') END AS t FROM documents)""")
def date_parse(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 7 == 0, "n/a").when(F.col("doc_id") % 11 == 0, "13/45/1890").otherwise(F.date_format("issue_date", "MM/dd/yyyy"))
    return table(spark, d, "documents").select("doc_id", text.parse_date(t).alias("parsed"))


_PHONES = "(SELECT phone_number FROM name1 UNION SELECT phone_number FROM name2 UNION SELECT phone_number FROM name3)"


@query(f"SELECT phone_number FROM {_PHONES} WHERE phone_number IS NOT NULL")
def phone_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return pairs.mask_map([table(spark, d, f"name{i}") for i in (1, 2, 3)], "phone_number", "salt").select("phone_number")


def _digest_sql(n: int, value: str, size: int) -> str:
    return f"(('0x' || substr(md5('salt/{n}/' || {value}), 1, 12))::BIGINT % {size})"


#: The permutation of ten-digit keys step by step, each round shifting one half by a digest of the other.
_MASKED_SQL = f"""(SELECT phone_number, CASE WHEN phone_number BETWEEN 1000000000 AND 9999999999 THEN (h2 + 10000) * 100000 + l2 ELSE 1000000000 + {_digest_sql(4, 'phone_number', 9_000_000_000)} END AS masked FROM (
    SELECT *, (h1 + {_digest_sql(3, 'l2', 90_000)}) % 90000 AS h2 FROM (SELECT *, (l1 + {_digest_sql(2, 'h1', 100_000)}) % 100000 AS l2 FROM (
    SELECT *, (h0 + {_digest_sql(1, 'l1', 90_000)}) % 90000 AS h1 FROM (SELECT *, (l0 + {_digest_sql(0, 'h0', 100_000)}) % 100000 AS l1 FROM (
    SELECT phone_number, phone_number // 100000 - 10000 AS h0, phone_number % 100000 AS l0 FROM {_PHONES} WHERE phone_number IS NOT NULL))))))"""


def _masks(spark: SparkSession, d: str) -> DataFrame:
    return pairs.mask_map([table(spark, d, f"name{i}") for i in (1, 2, 3)], "phone_number", "salt")


@query(f"SELECT name_id, m.masked AS phone_number FROM name1 LEFT JOIN {_MASKED_SQL} m USING (phone_number)")
def mask_join(spark: SparkSession, d: str) -> DataFrame:
    return pairs.apply_mask(table(spark, d, "name1").select("name_id", "phone_number"), _masks(spark, d), "phone_number")


@query(f"SELECT * FROM {_MASKED_SQL}")
def mask_hashed(spark: SparkSession, d: str) -> DataFrame:
    """The map with its checks: no mask is its own key or another's."""
    return pairs.checked_mask_map(_masks(spark, d), "phone_number")


@query("SELECT n_keys, count(*) AS n FROM (SELECT 1 AS n_keys) WHERE n_keys > 1 GROUP BY 1")
def mask_collisions(spark: SparkSession, d: str) -> DataFrame:
    return pairs.mask_collisions(_masks(spark, d)).groupBy("n_keys").agg(F.count(F.lit(1)).alias("n"))


_FULL_SQL = "regexp_replace(replace(coalesce(first_name{i}, '') || ' ' || coalesce(nullif(regexp_replace(middle_name{i}, '^\\s+|\\s+$', '', 'g'), ''), ' ') || ' ' || coalesce(last_name{i}, ''), '  ', ''), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT pair_id, {_FULL_SQL.format(i=1)} AS full_name1, {_FULL_SQL.format(i=2)} AS full_name2 FROM {_pairs_sql(coded=False)}")
def full_name(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("pair_id", *[text.full_name(f"first_name{i}", f"middle_name{i}", f"last_name{i}").alias(f"full_name{i}") for i in (1, 2)])


_CLEAN_SQL = "regexp_replace(regexp_replace({0}, '[&_.-]', ' ', 'g'), ' {{2,}}', ' ', 'g')"


@query(f"SELECT name_id, {_CLEAN_SQL.format('last_name')} AS cleaned, CASE WHEN last_name IS NULL THEN 0 ELSE length({_CLEAN_SQL.format('last_name')}) - length(replace({_CLEAN_SQL.format('last_name')}, ' ', '')) + 1 END AS n_pieces FROM name1")
def piece_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "name1").select("name_id", text.clean_pieces("last_name").alias("cleaned")).withColumn("n_pieces", text.count_pieces("cleaned"))


@query("SELECT name_id, CASE WHEN middle_name IS NULL THEN 0 ELSE length(middle_name) - length(replace(middle_name, ' ', '')) + 1 END AS n_tokens FROM name2")
def token_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "name2").select("name_id", text.count_pieces("middle_name").alias("n_tokens"))


# --- similarities, over all pairs ---

_AB = f"(SELECT pair_id, last_name1 AS a, last_name2 AS b FROM {_pairs_sql()})"
_L = "nullif(greatest(length(a), length(b)), 0)::DOUBLE"
_DISTINCT_AB = f"(SELECT DISTINCT a, b FROM {_AB} WHERE a IS NOT NULL AND b IS NOT NULL)"


def _dp_sql(cell: str, source: str = _DISTINCT_AB, final: str = "pr[length(b) + 1]") -> str:
    """A recursive dynamic program over the letters of a: rows pp (two back) and pr (one back) of the matrix; cell is the value at letter x of b."""
    return f"""WITH RECURSIVE dp AS (
        SELECT a, b, 0 AS i, NULL::BIGINT[] AS pp, range(0, length(b) + 1) AS pr FROM {source}
        UNION ALL
        SELECT a, b, i + 1, pr, list_reduce(list_transform(range(0, length(b) + 1), lambda x: [x]), lambda acc, y: list_append(acc, {cell}), CAST([] AS BIGINT[]))
        FROM dp WHERE i < length(a))
        SELECT a, b, {final} AS d FROM dp WHERE i = length(a)"""


_COST = "CASE WHEN substr(a, i + 1, 1) = substr(b, y[1]::BIGINT, 1) THEN 0 ELSE 1 END"
_SWAP = "CASE WHEN i >= 1 AND y[1] >= 2 AND substr(a, i + 1, 1) = substr(b, (y[1] - 1)::BIGINT, 1) AND substr(a, i, 1) = substr(b, y[1]::BIGINT, 1) THEN pp[(y[1] - 1)::BIGINT] + 1 ELSE 1000000 END"
_OSA_CELL = f"CASE WHEN y[1] = 0 THEN (i + 1)::BIGINT ELSE least(acc[len(acc)] + 1, pr[(y[1] + 1)::BIGINT] + 1, pr[y[1]::BIGINT] + {_COST}, {_SWAP}) END"
_LCS_CELL = f"CASE WHEN y[1] = 0 THEN (i + 1)::BIGINT ELSE least(acc[len(acc)] + 1, pr[(y[1] + 1)::BIGINT] + 1, pr[y[1]::BIGINT] + 2 * {_COST}) END"


def _similarity(method: str, sql: str | None) -> None:
    name = {"jw_floor": "dist_jaro", "soundex": "dist_soundex_cat"}.get(method, f"dist_{method}")

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _pairs(spark, d).select("pair_id", D.distance(method, "last_name1", "last_name2").alias("value"))

    run.__name__ = name
    query(sql)(run)


_similarity("lv", f"SELECT pair_id, 1 - levenshtein(a, b) / {_L} AS value FROM {_AB}")
_similarity("osa", f"SELECT pair_id, 1 - d / {_L} AS value FROM {_AB} LEFT JOIN ({_dp_sql(_OSA_CELL)}) USING (a, b)")
_similarity("dl", f"SELECT pair_id, 1 - damerau_levenshtein(a, b) / {_L} AS value FROM {_AB}")
_similarity("lcs", f"SELECT pair_id, 1 - d / {_L} AS value FROM {_AB} LEFT JOIN ({_dp_sql(_LCS_CELL)}) USING (a, b)")
_COUNTS = f"(SELECT a, b, c, sum(s) AS ca, sum(t) AS cb FROM (SELECT a, b, unnest(string_split(a, '')) AS c, 1 AS s, 0 AS t FROM {_DISTINCT_AB} UNION ALL SELECT a, b, unnest(string_split(b, '')) AS c, 0, 1 FROM {_DISTINCT_AB}) WHERE c <> '' GROUP BY 1, 2, 3)"
_similarity("qgram", f"SELECT pair_id, 1 - d / {_L} AS value FROM {_AB} LEFT JOIN (SELECT a, b, sum(abs(ca - cb)) AS d FROM {_COUNTS} GROUP BY 1, 2) USING (a, b)")
_similarity("cosine", f"SELECT pair_id, CASE WHEN {_L} IS NOT NULL THEN coalesce(v, 0) END AS value FROM {_AB} LEFT JOIN (SELECT a, b, sum(ca * cb) / nullif(sqrt(sum(ca * ca) * sum(cb * cb)), 0) AS v FROM {_COUNTS} GROUP BY 1, 2) USING (a, b)")
_similarity("jaccard", f"SELECT pair_id, CASE WHEN length(a) > 0 AND length(b) > 0 THEN jaccard(a, b) WHEN length(a) + length(b) > 0 THEN 0 END AS value FROM {_AB}")
_similarity("jw_floor", f"SELECT pair_id, jaro_similarity(a, b) AS value FROM {_AB}")
_JARO_SQL = f"""WITH RECURSIVE ja AS (
    SELECT a, b, 0 AS i, '' AS ma, list_transform(range(0, length(b)), lambda k: false) AS used FROM {_DISTINCT_AB}
    UNION ALL
    SELECT a, b, i + 1, CASE WHEN j IS NULL THEN ma ELSE ma || substr(a, i + 1, 1) END, list_transform(used, lambda u, k: u OR (j IS NOT NULL AND k = j))
    FROM (SELECT *, list_filter(range(greatest(1, i + 1 - reach), least(length(b), i + 1 + reach) + 1), lambda k: NOT used[k] AND substr(b, k::BIGINT, 1) = substr(a, i + 1, 1))[1] AS j FROM (SELECT *, greatest(greatest(length(a), length(b)) // 2 - 1, 0) AS reach FROM ja WHERE i < length(a))))
    SELECT a, b, CASE WHEN ma = '' THEN 0 ELSE (m / length(a) + m / length(b) + (m - len(list_filter(range(1, length(ma) + 1), lambda k: substr(ma, k::BIGINT, 1) <> mb[k])) / 2) / m) / 3 END AS v
    FROM (SELECT a, b, ma, length(ma)::DOUBLE AS m, list_transform(list_filter(range(1, length(b) + 1), lambda k: used[k]), lambda k: substr(b, k::BIGINT, 1)) AS mb FROM ja WHERE i = length(a))"""
_similarity("jw", f"SELECT pair_id, v AS value FROM {_AB} LEFT JOIN ({_JARO_SQL}) USING (a, b)")
_similarity("hamming", f"SELECT pair_id, CASE WHEN length(a) = length(b) THEN CASE WHEN length(a) = 0 THEN 0 ELSE hamming(a, b) END END AS value FROM {_AB}")


def _soundex_sql(c: str) -> str:
    """The code of a text that begins with a letter: H and W are transparent, vowels and other signs separate."""
    code = f"translate(regexp_replace(upper({c}), '[^A-Z]', '0', 'g'), 'BFPVCGJKQSXZDTLMNRAEIOUY', '111122222222334556000000')"
    rest = f"(substr({code}, 1, 1) || replace(replace(substr({code}, 2), 'H', ''), 'W', ''))"
    for k in "0123456":
        for _ in range(4):
            rest = f"replace({rest}, '{k}{k}', '{k}')"
    return f"CASE WHEN regexp_matches({c}, '^[a-zA-Z]') THEN upper(substr({c}, 1, 1)) || substr(rpad(replace(substr({rest}, 2), '0', ''), 3, '0'), 1, 3) END"


_EQUAL = " + ".join(f"CASE WHEN substr(x, {i}, 1) = substr(y, {i}, 1) THEN 1 ELSE 0 END" for i in range(1, 5))
_similarity("soundex", f"""WITH codes AS MATERIALIZED (SELECT t, {_soundex_sql('t')} AS code FROM (SELECT DISTINCT a AS t FROM {_AB} UNION SELECT DISTINCT b FROM {_AB}))
    SELECT pair_id, CASE WHEN x IS NULL OR y IS NULL THEN NULL ELSE ['No Match', 'Weak Match', 'Weak Similar Match', 'Similar Match', 'Strong Match'][1 + {_EQUAL}] END AS value
    FROM (SELECT pair_id, p.code AS x, q.code AS y FROM {_AB} LEFT JOIN codes p ON p.t = a LEFT JOIN codes q ON q.t = b)""")


_FULL_RVW = f"(SELECT *, {_FULL_SQL.format(i=1)} AS full_name1, {_FULL_SQL.format(i=2)} AS full_name2 FROM {_pairs_sql('ml_data_rvw')})"
_TEXTS = "(SELECT DISTINCT a, b FROM texts WHERE a IS NOT NULL AND b IS NOT NULL)"
_LETTERS = f"(SELECT a, b, c, sum(s) AS ca, sum(t) AS cb FROM (SELECT a, b, unnest(string_split(a, '')) AS c, 1 AS s, 0 AS t FROM {_TEXTS} UNION ALL SELECT a, b, unnest(string_split(b, '')) AS c, 0, 1 FROM {_TEXTS}) WHERE c <> '' GROUP BY 1, 2, 3)"
#: Each distinct pair of texts once, with all similarities; t has the rows.
_ALIKE_CTE = f"""t AS MATERIALIZED (SELECT * FROM {_FULL_RVW}), texts AS MATERIALIZED ({' UNION '.join(f'SELECT {a} AS a, {b} AS b FROM t' for a, b, _ in features.COLUMN_PAIRS)}),
    alike AS MATERIALIZED (SELECT a, b, 1 - o.d / {_L} AS osa, 1 - levenshtein(a, b) / {_L} AS lv, 1 - damerau_levenshtein(a, b) / {_L} AS dl, 1 - c.d / {_L} AS lcs, 1 - q.d / {_L} AS qgram, CASE WHEN {_L} IS NOT NULL THEN coalesce(q.v, 0) END AS cosine,
        CASE WHEN length(a) > 0 AND length(b) > 0 THEN jaccard(a, b) WHEN length(a) + length(b) > 0 THEN 0 END AS jaccard, j.v AS jw, CASE WHEN x.code IS NOT NULL AND y.code IS NOT NULL THEN ['No Match', 'Weak Match', 'Weak Similar Match', 'Similar Match', 'Strong Match'][1 + {_EQUAL.replace('substr(x,', 'substr(x.code,').replace('substr(y,', 'substr(y.code,')}] END AS soundex
        FROM {_TEXTS} LEFT JOIN ({_dp_sql(_OSA_CELL, _TEXTS)}) o USING (a, b) LEFT JOIN ({_dp_sql(_LCS_CELL, _TEXTS)}) c USING (a, b)
        LEFT JOIN (SELECT a, b, sum(abs(ca - cb)) AS d, sum(ca * cb) / nullif(sqrt(sum(ca * ca) * sum(cb * cb)), 0) AS v FROM {_LETTERS} GROUP BY 1, 2) q USING (a, b) LEFT JOIN ({_JARO_SQL.replace(_DISTINCT_AB, _TEXTS)}) j USING (a, b)
        LEFT JOIN (SELECT w, {_soundex_sql('w')} AS code FROM (SELECT a AS w FROM texts UNION SELECT b FROM texts)) x ON x.w = a LEFT JOIN (SELECT w, {_soundex_sql('w')} AS code FROM (SELECT a AS w FROM texts UNION SELECT b FROM texts)) y ON y.w = b)"""
_MATRIX_COLS = ", ".join(f"m{i}.{m} AS {a}_{b}_{'soundex_cat' if m == 'soundex' else m + '_pct'}" for i, (a, b, _) in enumerate(features.COLUMN_PAIRS) for m in D.METHODS)
_MATRIX_JOINS = " ".join(f"LEFT JOIN alike m{i} ON m{i}.a = t.{a} AND m{i}.b = t.{b}" for i, (a, b, _) in enumerate(features.COLUMN_PAIRS))


@query(f"WITH {_ALIKE_CTE} SELECT t.review_id, {_MATRIX_COLS} FROM t {_MATRIX_JOINS}")
def dist_matrix_54(spark: SparkSession, d: str) -> DataFrame:
    out = _pairs(spark, d, "ml_data_rvw").withColumns({f"full_name{i}": text.full_name(f"first_name{i}", f"middle_name{i}", f"last_name{i}") for i in (1, 2)})
    out = features.stringdist_matrix(out, features.COLUMN_PAIRS)
    return out.select("review_id", *[c for c in out.columns if c.endswith(("_pct", "_soundex_cat"))])


@query(f"""SELECT pair_id, least(length(a), length(b)) < 3 AND substr(a, 1, least(length(a), length(b))) = substr(b, 1, least(length(a), length(b))) AS initial, length(a) > 3 AND length(b) > 3 AND (contains(a, b) OR contains(b, a)) AS detect, substr(a, 1, 1) = substr(b, 1, 1) AS first_char
    FROM {_AB} WHERE a IS NOT NULL AND b IS NOT NULL""")
def token_predicates(spark: SparkSession, d: str) -> DataFrame:
    t = _pairs(spark, d).select("pair_id", F.col("last_name1").alias("a"), F.col("last_name2").alias("b")).dropna()
    return t.select("pair_id", D.initial_match("a", "b").alias("initial"), D.detect_long("a", "b").alias("detect"), D.first_char_match("a", "b").alias("first_char"))


# --- name pieces ---

_PIECE_SOURCE = f"(SELECT review_id AS id, {_CLEAN_SQL.format('a')} AS a, {_CLEAN_SQL.format('b')} AS b FROM (SELECT review_id, first_name1 || ' ' || last_name1 AS a, first_name2 || ' ' || last_name2 AS b FROM {_pairs_sql('ml_data_rvw', coded=False)}))"


def _piece_rows(spark: SparkSession, d: str) -> DataFrame:
    t = _pairs(spark, d, "ml_data_rvw")
    return t.select("review_id", F.concat("first_name1", F.lit(" "), "last_name1").alias("a"), F.concat("first_name2", F.lit(" "), "last_name2").alias("b"))


def _tokens_sql(source: str) -> str:
    return f"""(SELECT id, side, pos, val FROM (SELECT id, 1 AS side, unnest(string_split(a, ' ')) AS val, generate_subscripts(string_split(a, ' '), 1) AS pos FROM {source}
    UNION ALL SELECT id, 2, unnest(string_split(b, ' ')), generate_subscripts(string_split(b, ' '), 1) FROM {source}) WHERE val <> '')"""


_TOKENS = _tokens_sql(_PIECE_SOURCE)


@query(f"SELECT id AS review_id, side, pos, val FROM {_TOKENS}")
def piece_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = _piece_rows(spark, d)
    sides = [t.select("review_id", F.lit(i).alias("side"), F.posexplode(F.split(text.clean_pieces(c), " ")).alias("p", "val")) for i, c in ((1, "a"), (2, "b"))]
    return sides[0].unionByName(sides[1]).where("val <> ''").select("review_id", "side", (F.col("p") + 1).cast("long").alias("pos"), "val")


@query(f"SELECT x.id AS review_id, x.pos AS pos1, x.val AS val1, y.pos AS pos2, y.val AS val2 FROM {_TOKENS} x JOIN {_TOKENS} y ON x.id = y.id AND x.side = 1 AND y.side = 2")
def piece_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All token pairs within a row: two generators, no join."""
    out = _piece_rows(spark, d).select("review_id", "b", F.posexplode(F.split(text.clean_pieces("a"), " ")).alias("p", "val1")).select("review_id", "p", "val1", F.posexplode(F.split(text.clean_pieces("b"), " ")).alias("q", "val2"))
    return out.where("val1 <> '' and val2 <> ''").select("review_id", (F.col("p") + 1).cast("long").alias("pos1"), "val1", (F.col("q") + 1).cast("long").alias("pos2"), "val2")


def _pieces_cte(source: str) -> str:
    """pieces: id and the six features of each row of a source of (id, a, b), both cleaned."""
    return f"""k AS MATERIALIZED (SELECT * FROM {_tokens_sql(source)}), o AS MATERIALIZED (SELECT x.id, x.pos AS p1, x.val AS v1, y.pos AS p2, y.val AS v2 FROM k x JOIN k y ON x.id = y.id AND x.side = 1 AND y.side = 2),
    dist AS MATERIALIZED ({_dp_sql(_OSA_CELL, "(SELECT DISTINCT v1 AS a, v2 AS b FROM o)")}),
    m AS (SELECT o.*, d / greatest(length(v1), length(v2))::DOUBLE AS sd FROM o JOIN dist ON a = v1 AND b = v2),
    g1 AS (SELECT * FROM m QUALIFY sd = min(sd) OVER (PARTITION BY id, v1)), g2 AS (SELECT * FROM g1 QUALIFY sd = min(sd) OVER (PARTITION BY id, v2)),
    g3 AS (SELECT * FROM g2 QUALIFY row_number() OVER (PARTITION BY id, v1 ORDER BY p1, p2) = 1), g4 AS (SELECT * FROM g3 QUALIFY row_number() OVER (PARTITION BY id, v2 ORDER BY p1, p2) = 1),
    s AS (SELECT id, sum(CASE WHEN least(length(v1), length(v2)) < 3 AND substr(v1, 1, least(length(v1), length(v2))) = substr(v2, 1, least(length(v1), length(v2))) THEN 1 ELSE 0 END) AS f, 1 - avg(sd) AS sd, sum(CASE WHEN length(v1) > 3 AND length(v2) > 3 AND (contains(v1, v2) OR contains(v2, v1)) THEN 1 ELSE 0 END) AS de, sum(CASE WHEN v1 = v2 THEN 1 ELSE 0 END) AS ex FROM g4 GROUP BY id),
    n AS (SELECT *, CASE WHEN a IS NULL THEN 0 ELSE length(a) - length(replace(a, ' ', '')) + 1 END AS n1, CASE WHEN b IS NULL THEN 0 ELSE length(b) - length(replace(b, ' ', '')) + 1 END AS n2 FROM {source}),
    pieces AS MATERIALIZED (SELECT n.id, n1 AS name_count1, n2 AS name_count2, CASE WHEN n1 > 1 OR n2 > 1 THEN f END AS f_initial_match, CASE WHEN n1 > 1 OR n2 > 1 THEN sd END AS strdist, CASE WHEN n1 > 1 OR n2 > 1 THEN de END AS detect, CASE WHEN n1 > 1 OR n2 > 1 THEN ex END AS exact_match
    FROM n LEFT JOIN s USING (id))"""


@query(f"WITH {_pieces_cte(_PIECE_SOURCE)} SELECT id AS review_id, {', '.join(f'{p} AS fn_{p}' for p in features.PIECES)} FROM pieces")
def piece_features(spark: SparkSession, d: str) -> DataFrame:
    return features.name_pieces(_piece_rows(spark, d), "a", "b", "fn").drop("a", "b")


_GROUP_SOURCE = "(" + " UNION ALL ".join(f"SELECT review_id * 6 + {i} AS id, {_CLEAN_SQL.format(a)} AS a, {_CLEAN_SQL.format(b)} AS b FROM t" for i, (a, b, _) in enumerate(features.COLUMN_PAIRS)) + ")"
_GROUP_COLS = ", ".join(f"g{i}.{p} AS {g}_{p}" for i, (*_, g) in enumerate(features.COLUMN_PAIRS) for p in features.PIECES)
_GROUP_JOINS = " ".join(f"LEFT JOIN pieces g{i} ON g{i}.id = t.review_id * 6 + {i}" for i in range(len(features.COLUMN_PAIRS)))


@query(f"WITH {_ALIKE_CTE}, {_pieces_cte(_GROUP_SOURCE)} SELECT t.review_id, t.category, {_MATRIX_COLS}, {_GROUP_COLS} FROM t {_MATRIX_JOINS} {_GROUP_JOINS}")
def feature_table(spark: SparkSession, d: str) -> DataFrame:
    t = _pairs(spark, d, "ml_data_rvw")
    return features.feature_table(t.select("review_id", "category", *_SIX)).drop(*_SIX, "full_name1", "full_name2")


# --- sampling, balancing, splits; draws by arithmetic, so that both engines agree ---


def _draw(key: str):
    return ((F.col(key) * 7919) % 10007) / F.lit(10007.0)


def _tiers(spark: SparkSession, d: str) -> DataFrame:
    return sampling.tier_sample(pairs.edit_scores(_pairs(spark, d)), key="pair_id", draw=_draw("pair_id"))


_TIER_SQL = f"""(SELECT *, CASE WHEN coalesce(str_dist_all <> 1, true) AND ord <= floor(tot * 0.04 + 1e-9) THEN 1 ELSE 0 END AS kept FROM (
    SELECT * EXCLUDE (keep), count(*) OVER (PARTITION BY str_dist_all) AS tot, row_number() OVER (PARTITION BY str_dist_all ORDER BY ((pair_id * 7919) % 10007) / 10007.0, pair_id) AS ord FROM {_SCORED}))"""
_BOX = "(str_dist_all BETWEEN 0.3 AND 0.6 AND str_dist2 BETWEEN 0.8 AND 0.95 AND str_dist1 BETWEEN 0.4 AND 0.6) OR (str_dist_all BETWEEN 0.7 AND 0.85 AND str_dist2 BETWEEN 0.7 AND 0.95 AND str_dist1 BETWEEN 0.6 AND 0.85) OR (str_dist_all BETWEEN 0.6 AND 0.7 AND str_dist2 BETWEEN 0.7 AND 0.85 AND str_dist1 BETWEEN 0.5 AND 0.75)"


@query(f"SELECT pair_id, str_dist_all, tot, ord, kept AS keep FROM {_TIER_SQL}")
def tier_sample(spark: SparkSession, d: str) -> DataFrame:
    return _tiers(spark, d).select("pair_id", "str_dist_all", "tot", "ord", "keep")


@query(f"SELECT pair_id, CASE WHEN kept = 0 AND ({_BOX}) THEN 1 ELSE kept END AS keep FROM {_TIER_SQL}")
def edge_buckets(spark: SparkSession, d: str) -> DataFrame:
    return sampling.add_edge_cases(_tiers(spark, d)).select("pair_id", "keep")


@query(f"SELECT CASE WHEN kept = 0 AND ({_BOX}) THEN 1 ELSE kept END AS keep, count(*) AS n_pairs FROM {_TIER_SQL} GROUP BY 1")
def review_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.add_edge_cases(_tiers(spark, d)).groupBy("keep").agg(F.count(F.lit(1)).alias("n_pairs"))


@query("""WITH r AS (SELECT * FROM ml_data_rvw WHERE category IN ('Match', 'No Match')), k AS (SELECT greatest(1, ceil(0.9 * sum(CASE WHEN category = 'No Match' THEN 1 ELSE 0 END) / sum(CASE WHEN category = 'Match' THEN 1 ELSE 0 END)))::BIGINT AS k FROM r)
    SELECT review_id, category FROM r, k, range(1, CASE WHEN category = 'Match' THEN k ELSE 1 END + 1) AS g(n)""")
def balance_replicate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ml_data_rvw").where(F.col("category").isin("Match", "No Match"))
    return sampling.balance(rows, "category", "Match", "No Match").select("review_id", "category")


_TRAIN_SQL = "(SELECT review_id, row_number() OVER (ORDER BY ((review_id * 7919) % 10007) / 10007.0, review_id) AS rk, round_even(0.7 * count(*) OVER (), 0) AS n FROM ml_data_rvw WHERE category IS NOT NULL)"


def _train_test(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return sampling.split_exact(table(spark, d, "ml_data_rvw").where("category is not null"), key="review_id", draw=_draw("review_id"))


@query(f"SELECT review_id FROM {_TRAIN_SQL} WHERE rk <= n")
def train_split(spark: SparkSession, d: str) -> DataFrame:
    return _train_test(spark, d)[0].select("review_id")


@query(f"SELECT review_id FROM ml_data_rvw WHERE category IS NOT NULL AND review_id NOT IN (SELECT review_id FROM {_TRAIN_SQL} WHERE rk <= n)")
def test_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ml_data_rvw").where("category is not null").join(_train_test(spark, d)[0].select("review_id"), "review_id", "left_anti").select("review_id")


@query("SELECT review_id % 5 AS fold, count(*) AS n FROM ml_data_rvw GROUP BY 1")
def fold_mod(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ml_data_rvw").groupBy(sampling.fold("review_id").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, round(coalesce((l_quantity - avg(l_quantity) OVER ()) / nullif(stddev_samp(l_quantity) OVER (), 0), 0), 6) AS l_quantity_norm, round(coalesce((l_extendedprice - avg(l_extendedprice) OVER ()) / nullif(stddev_samp(l_extendedprice) OVER (), 0), 0), 6) AS l_extendedprice_norm FROM lineitem")
def zscore(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    return prepare.add_zscores(t, prepare.moments(t, ["l_quantity", "l_extendedprice"])).select("l_orderkey", "l_linenumber", F.round("l_quantity_norm", 6).alias("l_quantity_norm"), F.round("l_extendedprice_norm", 6).alias("l_extendedprice_norm"))


@query("SELECT name_id, coalesce(middle_name, '0') AS middle_name, coalesce(phone_number, 0) AS phone_number FROM name1")
def na_fill(spark: SparkSession, d: str) -> DataFrame:
    return prepare.fill_missing(table(spark, d, "name1").select("name_id", "middle_name", "phone_number"))


# --- evaluation over a fixed score: the edit similarity of both names ---

_RVW_SQL = f"(SELECT *, 1 - (levenshtein(first_name1, first_name2) + levenshtein(last_name1, last_name2)) / nullif(greatest(length(first_name1), length(first_name2)) + greatest(length(last_name1), length(last_name2)), 0)::DOUBLE AS prob, 1 - levenshtein(first_name1, first_name2) / nullif(greatest(length(first_name1), length(first_name2)), 0)::DOUBLE AS f, 1 - levenshtein(last_name1, last_name2) / nullif(greatest(length(last_name1), length(last_name2)), 0)::DOUBLE AS l FROM {_pairs_sql('ml_data_rvw')} WHERE category IN ('Match', 'No Match'))"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    t = _pairs(spark, d, "ml_data_rvw").where(F.col("category").isin("Match", "No Match"))
    n = lambda c: F.greatest(F.char_length(f"{c}1"), F.char_length(f"{c}2"))
    both = F.levenshtein("first_name1", "first_name2") + F.levenshtein("last_name1", "last_name2")
    return t.withColumns({"prob": 1 - F.try_divide(both.cast("double"), (n("first_name") + n("last_name")).cast("double")), "f": D.lv("first_name1", "first_name2"), "l": D.lv("last_name1", "last_name2")})


@query(f"SELECT review_id, prob, CASE WHEN prob > 0.5 THEN 'Match' WHEN prob IS NOT NULL THEN 'No Match' END AS decision FROM {_RVW_SQL}")
def score_threshold(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.decide(_scored(spark, d)).select("review_id", "prob", "decision")


@query(f"""SELECT sum(neg) OVER w / sum(neg) OVER ()::DOUBLE AS fpr, sum(pos) OVER w / sum(pos) OVER ()::DOUBLE AS tpr, 'edit' AS tp FROM (
    SELECT prob AS p, sum(CASE WHEN category = 'Match' THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN category = 'Match' THEN 0 ELSE 1 END) AS neg FROM {_RVW_SQL} WHERE prob IS NOT NULL GROUP BY 1) WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)""")
def roc_points(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.roc_points(_scored(spark, d), "prob", "category", name="edit")


@query(f"""WITH t AS (SELECT category, CASE WHEN prob > 0.5 THEN 'Match' ELSE 'No Match' END AS decision FROM {_RVW_SQL} WHERE prob IS NOT NULL), u AS (SELECT category AS actual, * FROM t UNION ALL SELECT 'Totals', * FROM t)
    SELECT 'edit' AS tp, actual, sum(CASE WHEN decision = 'Match' THEN 1 ELSE 0 END) AS "Match", sum(CASE WHEN decision = 'No Match' THEN 1 ELSE 0 END) AS "No Match", sum(CASE WHEN decision <> category THEN 1 ELSE 0 END) / count(*)::DOUBLE AS "Error", sum(CASE WHEN decision <> category THEN 1 ELSE 0 END) || '/' || count(*) AS "Rate" FROM u GROUP BY actual""")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(evaluate.decide(_scored(spark, d)), "category", "decision", "edit")


@query(f"""SELECT 'rejected' AS list, review_id FROM {_RVW_SQL} WHERE prob < 0.5 AND f > 0.5 AND l > 0.5 UNION ALL SELECT 'accepted', review_id FROM {_RVW_SQL} WHERE prob > 0.95 AND f < 0.8 AND l < 0.8 UNION ALL SELECT 'renamed', review_id FROM {_RVW_SQL} WHERE prob > 0.95 AND f < 0.8 AND l >= 0.9""")
def example_lists(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, df in evaluate.example_lists(_scored(spark, d), "prob", "f", "l").items():
        part = df.select(F.lit(name).alias("list"), "review_id")
        out = part if out is None else out.unionByName(part)
    return out


# --- models ---


#: Parameter maps that the queries try for each kind of model, and the seconds after which no further one is begun; the library's defaults are 500 and 1,800.
MOST, BUDGET_S = 2, 10
#: The cheap part of the search spaces, for the queries.
CHEAP = GRIDS | {k: GRIDS[k] | {"numTrees": [5, 10, 25], "maxDepth": [10]} for k in ("RF", "DRF")} | {"GBM": GRIDS["GBM"] | {"maxIter": [5, 10], "maxDepth": [5]}, "NN": {"hidden": [(32, 32, 32), (64, 64)]}}
ALL = ("RF", "GBM", "DRF", "NN", "GLM")
_matchers: dict[tuple, NameMatcher] = {}


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return sampling.split_exact(table(spark, d, "ml_data_rvw").where("category in ('Match', 'No Match')"), key="review_id")


def _trained(spark: SparkSession, d: str, kinds: tuple[str, ...]) -> NameMatcher:
    """A session's queries share the models of the same tables and kinds."""
    at = (spark.sparkContext.applicationId, d, kinds)
    if at not in _matchers:
        _matchers[at] = NameMatcher.train(_halves(spark, d)[0], key="review_id", kinds=kinds, most=MOST, budget_s=BUDGET_S, grids=CHEAP)
    return _matchers[at]


def _model_query(name: str, model: str, kinds: tuple[str, ...]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = _trained(spark, d, kinds).transform(_halves(spark, d)[1], model=model)
        return evaluate.confusion(out, "category", "decision", name)

    run.__name__ = name
    query()(run)


for _n, _m, _k in (("ml_lr", "GLM", ("GLM",)), ("ml_rf", "RF", ALL), ("ml_gbt", "GBM", ALL), ("ml_drf", "DRF", ALL), ("ml_mlp", "NN", ALL), ("ml_stack", "ENS", ALL), ("ml_stack2", "ENS2", ALL)):
    _model_query(_n, _m, _k)


def _report_query(name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _trained(spark, d, ALL).reports(_halves(spark, d)[1])[name]

    run.__name__ = f"ml_{name}"
    query()(run)


for _n in ("roc", "confusion", "predictions"):
    _report_query(_n)


@query()
def name_match_e2e(spark: SparkSession, d: str) -> DataFrame:
    """The matcher, trained on the reviewed pairs, over all candidate pairs."""
    return _trained(spark, d, ("GLM", "RF")).transform(table(spark, d, "ml_data")).select("pair_id", "prob", "decision")
