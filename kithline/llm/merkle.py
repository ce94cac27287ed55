"""Duplicates hidden by formatting differences: Merkle-style hashing of nested records.

A record is a tree: leaves are text fields, normalised; an ordered node hashes its children's digests in their order, an
unordered node sorts them first.  Equal roots are copies, confirmed by comparing the normalised trees themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kithline.operators.skew import cut_lineage

#: Groups above HOT rows are salted SALT ways.  Among N rows there are at most N / HOT of them: for 10 billion rows, 10,000 digests are broadcast.
HOT, SALT = 1_000_000, 64


def field_letters(c: Column | str) -> Column:
    """Letters and digits in lower case; null for null and for a text that has none."""
    return F.nullif(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def leaf(value: Column) -> Column:
    """Digest of a leaf; a null leaf has a digest of its own."""
    return F.when(value.isNull(), F.xxhash64(F.lit("null"))).otherwise(F.xxhash64(F.lit("leaf"), value.cast("string")))


def ordered(*children: Column) -> Column:
    return F.xxhash64(F.lit("ordered"), *children)


def unordered(children: Column) -> Column:
    """children: an array of digests."""
    return F.xxhash64(F.lit("unordered"), F.array_sort(children))


def normalised(c: Column, kind: T.DataType, text: Callable[[Column], Column], loose: bool) -> Column:
    """A nested value with its leaves as texts, normalised, and the fields of structs in order of name; loose: the elements of arrays in ascending order, too.  Maps are arrays of their entries, always in order."""
    inner = lambda v, k: normalised(v, k, text, loose)
    if isinstance(kind, T.StructType):
        fields = [inner(c[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(sorted(kind.fields, key=lambda f: f.name))]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        out = F.transform(c, lambda v: inner(v, kind.elementType))
        return F.array_sort(out) if loose else out
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(inner(e["key"], kind.keyType).alias("k"), inner(e["value"], kind.valueType).alias("v"))))
    return text(c.cast("string"))


def digest(c: Column, kind: T.DataType, loose: bool) -> Column:
    """Digest of a normalised value, from the leaves upwards; a null at any level has that of a null leaf."""
    if isinstance(kind, T.StructType):
        out = ordered(*[digest(c[f"f{i}"], f.dataType, loose) for i, f in enumerate(sorted(kind.fields, key=lambda f: f.name))])
    elif isinstance(kind, T.ArrayType):
        children = F.transform(c, lambda v: digest(v, kind.elementType, loose))
        out = unordered(children) if loose else F.xxhash64(F.lit("list"), children)
    elif isinstance(kind, T.MapType):
        out = unordered(F.transform(c, lambda e: ordered(digest(e["k"], kind.keyType, loose), digest(e["v"], kind.valueType, loose))))
    else:
        return leaf(c)
    return F.when(c.isNull(), leaf(F.lit(None))).otherwise(out)


def collapse_copies(records: DataFrame, *, key: str, exact: Sequence[str], free: Sequence[str], loose: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(collapsed, copies) of records equal but for formatting.

    Two records are copies if the columns `exact` are equal as they stand (null equals null) and the columns `free`, reduced
    to letters and digits in lower case, hold the same values in whatever order, fields without letters counting as absent.  Columns of exact may be
    nested; columns of loose, texts or nested values, are equal if their leaves are, reduced like that, and arrays in them hold the same in whatever order.

    collapsed: key (the smallest), n_copies: one row for each record.  copies: pair_id_a (smallest key), pair_id_b: one row for every other copy.
    A repeated key is one more copy in n_copies, and a row of copies only if it differs from the smallest.  Keys must not be null.

    First only digests are counted, with partial aggregation, so that a group that holds a third of all rows costs no task more than others.
    The records themselves are shuffled where a digest occurs several times; those are grouped by the whole tree, so a collision of digests
    joins nothing that differs.  In joins, the rows of a large group are split by salt (see HOT).
    """
    kept = F.array_compact(F.array(*[field_letters(c) for c in free])) if free else F.array().cast("array<string>")
    kinds = [(c, records.schema[c].dataType, False) for c in exact] + [(c, records.schema[c].dataType, True) for c in loose]
    nodes = [normalised(F.col(c), t, field_letters if free_ else lambda x: x, free_).alias(f"e{i}") for i, (c, t, free_) in enumerate(kinds)]
    rows = records.select(F.col(key).alias("_key"), F.struct(*nodes, F.array_sort(kept).alias("free")).alias("_tree"))
    root = ordered(*[digest(F.col(f"_tree.e{i}"), t, free_) for i, (_, t, free_) in enumerate(kinds)], unordered(F.transform("_tree.free", leaf)))
    rows = rows.withColumn("_root", root)
    state = rows.groupBy("_root").agg(F.min("_key").alias("_min"), F.count(F.lit(1)).alias("_n"))
    parts = F.when(F.col("_n") > HOT, SALT).otherwise(1)
    salt = F.when(F.col("_parts") > 1, F.pmod(F.xxhash64("_key"), F.lit(SALT))).otherwise(0).cast("int")
    several = state.where("_n > 1").select(F.col("_root").alias("_r"), parts.alias("_parts"))
    large = several.where("_parts > 1").select(F.col("_r").alias("_root"), "_parts")
    marked = rows.join(F.broadcast(large), "_root", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).withColumn("_salt", salt)
    spread = several.withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    matched = cut_lineage(marked.join(spread, (F.col("_root") == F.col("_r")) & (F.col("_salt") == F.col("_s"))).select("_root", "_tree", "_key", "_parts", "_salt"))
    groups = matched.groupBy("_root", "_tree").agg(F.min("_key").alias("_min"), F.count(F.lit(1)).alias("_n"), F.max("_parts").alias("_parts"))
    collapsed = state.where("_n = 1").select(F.col("_min").alias(key), F.col("_n").alias("n_copies")).unionByName(groups.select(F.col("_min").alias(key), F.col("_n").alias("n_copies")))
    heads = groups.where("_n > 1").select(F.col("_root").alias("_r"), F.col("_tree").alias("_t"), "_min", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_s"))
    copies = matched.join(heads, (F.col("_root") == F.col("_r")) & (F.col("_salt") == F.col("_s")) & (F.col("_tree") == F.col("_t"))).where("_key <> _min")
    return collapsed, copies.select(F.col("_min").alias("pair_id_a"), F.col("_key").alias("pair_id_b"))
