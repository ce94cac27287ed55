"""From features to a model's table: missing values, normalisation, predictors."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fill_missing(df: DataFrame, text: str = "0") -> DataFrame:
    """Null and NaN become 0, in string columns the text."""
    out = []
    for n, t in df.dtypes:
        c = F.col(f"`{n}`")
        if t in ("double", "float"):
            c = F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0).cast(t))
        elif t == "string":
            c = F.coalesce(c, F.lit(text))
        elif t in ("tinyint", "smallint", "int", "bigint") or t.startswith("decimal"):
            c = F.coalesce(c, F.lit(0).cast(t))
        out.append(c.alias(n))
    return df.select(*out)


def moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """{column: (mean, sample standard deviation)} without nulls and NaN, in one pass."""
    real = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in cols}
    row = df.agg(*[f(v).alias(f"{k}{i}") for i, v in enumerate(real.values()) for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def add_zscores(df: DataFrame, stats: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """df with {column}_norm; 0 for constant columns, nulls and NaN.  stats come from moments, of the training rows."""
    def score(c: str, mean: float | None, sd: float | None):
        if mean is None or not sd or sd != sd:
            return F.lit(0.0)
        z = (F.col(f"`{c}`").cast("double") - F.lit(mean)) / F.lit(sd)
        return F.coalesce(F.when(~F.isnan(z), z), F.lit(0.0))

    return df.withColumns({f"{c}_norm": score(c, *s) for c, s in stats.items()})


#: Columns that are no predictors (identifiers, names, the label); the pattern also meets all features of the middle names.
NOT_PREDICTORS = re.compile(r"^(phone_number|category|ord|keep|pair_id|review_id|C1|(first|last|full)_name[12]|middle_name1.*|middle_name2)$")


def predictors(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if not NOT_PREDICTORS.match(c)]
