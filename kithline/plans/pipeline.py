"""The stages from raw feeds to review files and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithline.functions.text import digits, null_tokens, parse_date, to_number, trim_blanks
from kithline.operators import pairs, reshape, sampling
from kithline.operators.features import feature_table
from kithline.operators.skew import cut_lineage


def clean_exp(feed: DataFrame) -> DataFrame:
    """Distinct (phone_number, first_name, middle_name, last_name) of a raw feed with one name per row.

    Texts for missing values are nulls, phones are their digits, names are trimmed and in lower case; rows without first or last name are dropped.
    """
    t = null_tokens(feed)
    name = lambda c: trim_blanks(F.lower(c))
    out = t.select(to_number(digits("primary_phone")).alias("phone_number"), name("first_name").alias("first_name"), name("middle_initial").alias("middle_name"), name("last_name").alias("last_name"))
    return out.dropna(subset=["first_name", "last_name"]).distinct()


def _dated(df: DataFrame) -> DataFrame:
    """Columns of first and last sight as dates."""
    return df.withColumns({c: parse_date(f"`{c}`") for c in df.columns if c.endswith(("first_seen", "last_seen"))})


def _named(df: DataFrame, phone: str, first: str, middle: str, last: str) -> DataFrame:
    """Distinct (phone_number, first_name, middle_name, last_name), phones as numbers, names in lower case, of rows with a first and a last name."""
    out = df.select(to_number(digits(phone)).alias("phone_number"), *[trim_blanks(F.lower(c)).alias(n) for c, n in ((first, "first_name"), (middle, "middle_name"), (last, "last_name"))])
    return out.dropna(subset=["first_name", "last_name"]).distinct()


def long_mcr(feed: DataFrame) -> DataFrame:
    """key, phone, mcr_ord and the attributes of each listing of a raw feed with camel-case columns, in long form."""
    t = _dated(null_tokens(reshape.rename_columns(feed, reshape.camel_name)))
    return reshape.unpivot_groups(t, ["key", "phone"], reshape.listings(t.columns), "mcr_ord")


def clean_mcr(feed: DataFrame) -> DataFrame:
    """Names of a raw feed of listings; the apostrophe before a phone goes with all that isn't a digit."""
    return _named(long_mcr(feed), "phone", "first_name", "middle_name", "last_name")


def long_tu(feed: DataFrame) -> DataFrame:
    """phonenumber, tu_subject, tu_address (both numbers), names and address attributes of a raw feed of subjects with their addresses, in long form."""
    t = _dated(null_tokens(reshape.rename_columns(feed, reshape.marked_name)))
    groups = {(s.removeprefix("subject"), a.removeprefix("address")): g for (s, a), g in reshape.subject_addresses(t.columns).items()}
    return reshape.unpivot_groups(t, ["phonenumber"], groups, ["tu_subject", "tu_address"])


def clean_tu(feed: DataFrame) -> DataFrame:
    """Names of a raw feed of subjects.  The sentinel for missing addresses doesn't change them (see reshape.address_sentinel), so it's left out."""
    return _named(long_tu(feed), "phonenumber", "first_name", "middle_name", "last_name")


def build_names(feeds: list[DataFrame], salt: str) -> list[DataFrame]:
    """The name tables with masked phones; a phone has the same mask in all of them, null stays null, and masks are checked."""
    masks = cut_lineage(pairs.checked_mask_map(pairs.mask_map(feeds, "phone_number", salt), "phone_number"))
    return [pairs.distinct_names(pairs.apply_mask(f, masks, "phone_number")) for f in feeds]


def build_pairs(mcr: DataFrame, tu: DataFrame, exp: DataFrame, *, seed: int = 7) -> DataFrame:
    """Candidate pairs of three name tables with edit scores and the choice for review."""
    scored = pairs.edit_scores(pairs.all_pairs(mcr, tu, exp)).withColumn("_pair", F.xxhash64("phone_number", *[f"{c}{i}" for c in pairs.NAME for i in (1, 2)]))
    return sampling.add_edge_cases(sampling.tier_sample(scored, key="_pair", seed=seed)).drop("_pair", "rand")


def build_features(reviewed: DataFrame) -> DataFrame:
    """Features of the labelled pairs."""
    return feature_table(reviewed.where("category is not null"))
