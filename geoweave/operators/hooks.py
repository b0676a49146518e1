"""Extension surface (E2-E4, E6) and parameterised views.

Hooks are plain callables ``DataFrame → DataFrame`` or SQL text over temp views;
parameters are bound through ``spark.sql(..., args=…)`` after validation, never
spliced into the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

Hook = Callable[[DataFrame], DataFrame] | str


def register_view(df: DataFrame, name: str) -> DataFrame:
    """A virtual table (temp view) usable by later SQL."""
    df.createOrReplaceTempView(name)
    return df


def post_load(df: DataFrame, hook: Hook | None, view: str = "loaded") -> DataFrame:
    """Post-load step per subset — a callable, or SQL over the subset registered as ``view``."""
    if hook is None:
        return df
    if callable(hook):
        return hook(df)
    register_view(df, view)
    return df.sparkSession.sql(hook)


RAW_BUILDING_COLUMNS = {"id", "gmlid", "geom", "mh"}
RAW_SURFACE_COLUMNS = {"building_gmlid", "gmlid", "class", "geom"}


def preprocess(df: DataFrame, hook: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Preprocessing hook that must produce the raw buildings and raw surfaces tables."""
    raw_b, raw_s = hook(df)
    for name, got, need in (("raw buildings", raw_b, RAW_BUILDING_COLUMNS), ("raw surfaces", raw_s, RAW_SURFACE_COLUMNS)):
        missing = need - set(got.columns)
        if missing:
            raise ValueError(f"{name} table lacks columns {sorted(missing)}")
    return raw_b, raw_s


def apply_lenses(spark: SparkSession, lenses: Sequence[Mapping]) -> dict[str, DataFrame]:
    """Derived relations ``[{"name": …, "sql": …}, …]`` (several files concatenated) applied in order;
    a later lens may read an earlier one."""
    out = {}
    for lens in lenses:
        df = spark.sql(lens["sql"])
        register_view(df, lens["name"])
        out[lens["name"]] = df
    return out


def param_view(spark: SparkSession, sql: str, params: Mapping[str, object], validators: Mapping[str, str] | None = None,
               defaults: Mapping[str, object] | None = None) -> DataFrame:
    """SQL view with named parameters (``:name`` markers), defaults and validating regexes.

    Values are checked with ``re.fullmatch`` on the driver and bound as SQL
    arguments, so they can never change the statement's structure.
    """
    args = {**(defaults or {}), **params}
    for k, pattern in (validators or {}).items():
        if k in args and not re.fullmatch(pattern, str(args[k])):
            raise ValueError(f"parameter {k}={args[k]!r} does not match {pattern!r}")
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*", " ", sql)  # markers in quotes and comments are no parameters
    used = set(re.findall(r"(?<![:\w]):([A-Za-z_]\w*)", bare))  # a cast ``::int`` is none either
    missing = used - set(args)
    if missing:
        raise ValueError(f"missing parameters {sorted(missing)}")
    return spark.sql(sql, args={k: v for k, v in args.items() if k in used})
