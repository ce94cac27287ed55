"""Operators that stay balanced when one key holds a large part of all rows.

The common trick is a two-level decomposition: work first on (key, salt) cells of bounded size,
then on the much smaller table of cells.  No operator here collects a key's rows into one task.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one cell holds, about, when the members of a group are ranked; the number of cells follows from the number of rows.
CELL_ROWS = 200_000
#: Spark's setting by which a query's shuffle files are deleted when it ends, and not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df as a table to the cluster's shared checkpoint folder and read it from there.

    The folder is spark.checkpoint.dir.  A session without one gets a temporary folder if it runs within one process (master local[...]); on a
    cluster that is an error, as executors couldn't share it.  The table survives the loss of executors and is deleted when the driver ends.  Unlike a
    checkpoint it has its true size as its statistics: those of checkpoints are the products of what was joined, and grow without bound in iterations.
    The shuffle files of df are deleted once the table is written.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="kithline-"))
    at = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    kept = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if kept is None else spark.conf.set(SHUFFLE_CLEANUP, kept)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


def release(spark: SparkSession) -> None:
    """Let the driver drop what ended queries left: plans, broadcasts and shuffles go when its JVM collects its garbage, and until then its heap grows, up to all that it may have."""
    spark._jvm.System.gc()


def unit_hash(key: Column | str, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only, never on the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key) if isinstance(key, str) else key), F.lit(1 << 48)) / F.lit(float(1 << 48))


def distributed_rank(df: DataFrame, group: Sequence[str], draw: str, tie: str, out: str, cells: int | None = None) -> DataFrame:
    """Number the rows of each group 1..n by ascending (draw, tie) without sorting a whole group in one task.

    draw is a column in [0, 1), evenly spread (a hash).  The group is cut into `cells` ranges of draw, by default one for each CELL_ROWS rows
    of the table; the cells' counts give each cell's offset, and only rows within one cell are sorted together.
    Null group keys form a group of their own.  An empty table gives an empty table.
    """
    cells = cells or max(1, -(-df.count() // CELL_ROWS))
    c, off = f"_cell_{out}", f"_off_{out}"
    keyed = df.withColumn(c, F.floor(F.col(draw) * cells).cast("int"))
    counts = keyed.groupBy(*group, c).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(g).alias(f"_g_{i}") for i, g in enumerate(group)], F.col(c).alias("_gc"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(off))
    same = F.col(c) == F.col("_gc")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{i}"))
    inside = F.row_number().over(Window.partitionBy(*group, c).orderBy(draw, tie))
    return keyed.withColumn("_in", inside).join(offsets, same).withColumn(out, F.col(off) + F.col("_in")).drop(c, off, "_in", "_gc", *[f"_g_{i}" for i in range(len(group))])


def eager_join_aggregate(left: DataFrame, right: DataFrame, key: str, left_sums: dict[str, Column], right_sums: dict[str, Column], how: str = "left") -> DataFrame:
    """Per-key aggregates of `left JOIN right USING (key)` without producing the joined rows.

    Both sides are first aggregated by the key (partial aggregation runs before the shuffle, so a hot key
    sends one row per task), the compact states are joined one to one, and the algebra of the join is applied
    to them: the number of joined rows is the product of the counts; a sum over the left side is multiplied by
    the right count and the other way round.

    Columns: key, left_rows, right_rows, join_rows, and for each entry of left_sums / right_sums the sum over
    the side (`name`) and over the joined rows (`name_joined`).  Rows with a null key join nothing and are left
    out, as an equi-join does.  how="left" keeps keys without partners (join_rows 0); how="inner" drops them.
    """
    if set(left_sums) & set(right_sums):
        raise ValueError("left_sums and right_sums share a name")
    a = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("left_rows"), *[F.sum(c).alias(n) for n, c in left_sums.items()])
    b = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("right_rows"), *[F.sum(c).alias(n) for n, c in right_sums.items()])
    j = a.join(b, key, how).withColumn("right_rows", F.coalesce("right_rows", F.lit(0)))
    return j.select(
        key, "left_rows", "right_rows", (F.col("left_rows") * F.col("right_rows")).alias("join_rows"),
        *[F.col(n) for n in [*left_sums, *right_sums]],
        *[(F.col(n) * F.col("right_rows")).alias(f"{n}_joined") for n in left_sums],
        *[(F.coalesce(F.col(n), F.lit(0)) * F.col("left_rows")).alias(f"{n}_joined") for n in right_sums],
    )


def distinct_per_key(df: DataFrame, key: str, sets: dict[str, Sequence[str]]) -> DataFrame:
    """Exact numbers of distinct value tuples per key: {result name: columns}; nulls count as a value.

    Every tuple is its 128-bit digest.  Level one removes repetitions of (key, all digests that a row needs), with partial aggregation, so a hot
    key is spread over all tasks and each row is carried once, whatever the number of sets.  Level two removes, from what is left, the repetitions
    of each set by itself; a set that holds all digests is counted at level one already.  Level three counts with partial aggregates.
    """
    every = list(dict.fromkeys(c for cols in sets.values() for c in cols))
    parts: list[list[str]] = []  # columns that no set takes apart share a digest
    for c in every:
        mates = [p for p in parts if all((c in cols) == (p[0] in cols) for cols in sets.values())]
        if mates:
            mates[0].append(c)
        else:
            parts.append([c])
    # a null differs from every text, as each value comes with whether it is one
    digest = lambda k, cols: F.struct(*[F.xxhash64(F.lit(k), *[x for c in cols for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]).alias(f"h{k}") for k in (1, 2)])
    names = [f"_p{i}" for i in range(len(parts))]
    tuples = df.select(F.col(f"`{key}`").alias(key), *[digest(1, p).alias(n) for n, p in zip(names, parts)]).groupBy(key, *names).agg(F.lit(1).alias("_once"))
    of = {n: [x for x, p in zip(names, parts) if p[0] in cols] for n, cols in sets.items()}
    whole = [n for n, p in of.items() if len(p) == len(names)]
    some = {n: p for n, p in of.items() if len(p) < len(names)}
    tagged = [F.struct(F.lit(i).alias("_set"), *[(F.col(x) if x in p else F.lit(None).cast("struct<h1:bigint,h2:bigint>")).alias(x) for x in names]) for i, p in enumerate(some.values())]
    counts = tuples.groupBy(key).agg(F.count(F.lit(1)).alias("_all")).select(F.col(key).alias("_k"), *[F.col("_all").alias(n) for n in whole])
    if not some:
        return counts.withColumnRenamed("_k", key).select(key, *sets)
    single = tuples.select(key, F.inline(F.array(*tagged))).distinct().groupBy(key).agg(*[F.count(F.when(F.col("_set") == i, 1)).alias(n) for i, n in enumerate(some)])
    return single.join(counts, F.col(key).eqNullSafe(F.col("_k"))).select(key, *sets)


def hot_keys(df: DataFrame, key: str, share: float, *, nulls: bool = False) -> DataFrame:
    """Keys that hold at least `share` of all rows, with their count; at most 1/share keys can qualify.

    Null keys count among all rows; nulls: the null key is returned, too, if it is hot.  An empty table has no hot keys.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    hot = (counts if nulls else counts.where(F.col(key).isNotNull())).join(F.broadcast(total), F.col("_n") >= F.col("_total") * share)
    return hot.select(key, F.col("_n").alias("n_rows"), (F.col("_n") / F.col("_total")).alias("share"))


def running_sums(df: DataFrame, order: Column, sums: dict[str, str]) -> DataFrame:
    """df with running sums along an order of distinct values: {new column: summed column}, without a window over the whole table in one task.

    The rows are partitioned by range of the order; partitions, of which there are few, are summed, and each gets the sum of those before it.
    Only rows of one partition are sorted together.  An empty table stays empty.
    """
    ranged = cut_lineage(df.withColumn("_o", order).repartitionByRange("_o").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    offsets = parts.select(F.col("_part").alias("_q"), *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = Window.partitionBy("_part").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.withColumns({f"_i_{n}": F.sum(c).over(inside) for n, c in sums.items()}).join(F.broadcast(offsets), F.col("_part") == F.col("_q"))
    return run.select(*[f"`{c}`" for c in df.columns], *[(F.col(f"_b_{n}") + F.col(f"_i_{n}")).alias(n) for n in sums])
