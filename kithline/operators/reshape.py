"""Column names, wide to long, and addresses of a feed."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithline.functions.text import any_not_null

#: What stands in for an address that isn't known, and its tag.
NO_ADDRESS, NO_ADDRESS_TAG = "**No Address Information Provided for this Phone Number and Name**", "1-10"
ADDRESS_PREFIX, SUBJECT_PREFIX = "tu_address", "tu_subject"
#: The words of a column name.
_WORDS = re.compile(r"[A-Z][a-z]+[0-9]+|[A-Z][a-z]+|[a-z]+|[A-Z]+")


def dotted_name(name: str) -> str:
    """Lower case, with underscores for dots."""
    return name.lower().replace(".", "_")


def camel_name(name: str) -> str:
    """Words of a camel-case name joined by underscores, after one leading i: iPhoneListing1FirstName is phone_listing1_first_name."""
    return "_".join(_WORDS.findall(re.sub("^i", "", name, count=1))).lower()


def marked_name(name: str, mark: str = "Tlo") -> str:
    """As camel_name, with a feed's mark as a separator."""
    return "_".join(_WORDS.findall(name.replace(mark, "_").lstrip("_"))).lower()


def rename_columns(df: DataFrame, rule: Callable[[str], str]) -> DataFrame:
    """All columns renamed by a rule; two that would get one name are an error."""
    names = [rule(c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("the rule gives two columns one name")
    return df.toDF(*names)


def select_matching(df: DataFrame, pattern: str) -> DataFrame:
    """The columns whose names a regular expression finds something in."""
    return df.select(*[f"`{c}`" for c in df.columns if re.search(pattern, c)])


def drop_all_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with a value in at least one of the columns."""
    return df.where(any_not_null(*[f"`{c}`" for c in cols]))


def unpivot_groups(df: DataFrame, keys: Sequence[str], groups: dict[str | tuple[str, ...], dict[str, str]], tag: str | Sequence[str], required: Sequence[str] | None = None) -> DataFrame:
    """One row for each repeated group of columns: keys, the tag, and the group's attributes.

    groups: {tag value: {attribute: column}}; an attribute that a group lacks is null.  For nested groups, such as the addresses of
    subjects, tag is several names and the tag values are tuples.  Groups without a value in any of the `required` attributes
    (default: all) give no row.  One pass: the groups are an array of structs that is inlined.
    """
    attributes = list(dict.fromkeys(a for g in groups.values() for a in g))
    types = dict(df.dtypes)
    kind = {a: next(types[g[a]] for g in groups.values() if a in g) for a in attributes}
    tags = [tag] if isinstance(tag, str) else list(tag)
    values = lambda name: [name] if isinstance(name, str) else list(name)
    rows = [F.struct(*[F.lit(v).alias(t) for t, v in zip(tags, values(name))], *[(F.col(f"`{g[a]}`") if a in g else F.lit(None)).cast(kind[a]).alias(a) for a in attributes]) for name, g in groups.items()]
    return drop_all_null(df.select(*[f"`{k}`" for k in keys], F.inline(F.array(*rows))), list(required or attributes))


def subject_addresses(columns: Sequence[str], subjects: int = 5, addresses: int = 10) -> dict[tuple[str, str], dict[str, str]]:
    """Groups of a feed with columns subject{i}_name_{part} and subject{i}_address{a}_{part}, for unpivot_groups with the tags
    (tu_subject, tu_address); a subject's name is in each of its groups."""
    out: dict[tuple[str, str], dict[str, str]] = {}
    for i in range(1, subjects + 1):
        names = {c.removeprefix(f"subject{i}_name_"): c for c in columns if c.startswith(f"subject{i}_name_")}
        for a in range(1, addresses + 1):
            own = {c.removeprefix(f"subject{i}_address{a}_"): c for c in columns if c.startswith(f"subject{i}_address{a}_")}
            if own:
                out[f"subject{i}", f"address{a}"] = names | own
    return out


def listings(columns: Sequence[str], n: int = 10) -> dict[str, dict[str, str]]:
    """Groups of a feed with columns phone_listing{i}_{attribute}, for unpivot_groups with the tag mcr_ord."""
    every = {f"phone_listing{i}": {c.removeprefix(f"phone_listing{i}_"): c for c in columns if c.startswith(f"phone_listing{i}_")} for i in range(1, n + 1)}
    return {k: v for k, v in every.items() if v}


def address_sentinel(df: DataFrame, keys: Sequence[str], subject: str, address: str, attributes: Sequence[str]) -> DataFrame:
    """Rows of subjects with a single record say that there is no other address; rows without any address attribute are dropped.

    keys: columns of the person (phone and names); subject and address: the tags; attributes: the address columns, the first of which is the full address.
    Where a person's subject has one distinct record, the address tag aside, all rows of that person and subject get NO_ADDRESS as full address,
    NO_ADDRESS_TAG as address tag, and as subject the list of all such subjects of the person in ascending order; their other attributes stay.  Then both
    tags get their prefixes, and repeated rows go.  Null keys are equal to each other.

    A subject's records are counted with partial aggregation over distinct rows.  The list of subjects is short, as a feed has few per row.
    """
    records = df.drop(address).distinct()
    single = records.groupBy(*keys, subject).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1")
    of = single.groupBy(*keys).agg(F.sort_array(F.collect_set(subject)).alias("_subjects"))
    match = lambda t, cols: [F.col(f"l.{c}").eqNullSafe(F.col(f"{t}.{c}")) for c in cols]
    marked = df.alias("l").join(single.alias("s"), match("s", [*keys, subject]), "left").join(of.alias("o"), match("o", keys), "left")
    alone = F.col("s._n").isNotNull()
    own = lambda c: F.col(f"l.{c}")
    out = marked.select(
        *[own(k) for k in keys],
        F.concat(F.lit(SUBJECT_PREFIX), F.when(alone, F.array_join("o._subjects", ", ")).otherwise(own(subject).cast("string"))).alias(subject),
        F.concat(F.lit(ADDRESS_PREFIX), F.when(alone, F.lit(NO_ADDRESS_TAG)).otherwise(own(address).cast("string"))).alias(address),
        F.when(alone, F.lit(NO_ADDRESS)).otherwise(own(attributes[0])).alias(attributes[0]),
        *[own(a) for a in attributes[1:]],
    )
    return drop_all_null(out.distinct(), attributes)


def first_of_group(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group in an explicit order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_rn = 1").drop("_rn")
