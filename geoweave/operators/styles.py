"""Styling as data (P12, P13, R7): rule tables joined to features, colour maps as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.functions.util import as_col


def apply_style_rules(df: DataFrame, rules: DataFrame, exclusive: bool = False) -> DataFrame:
    """Attribute-equality rules ``rules(property, value, <style columns…>)``.

    General form: one output row per matching rule (unmatched features disappear,
    as a renderer draws nothing for them).  The features are read once: each row lists its attribute
    values under their names and one equi-join on (property, value) meets the rules.  A rule
    whose property no feature column has matches nothing.
    """
    style_cols = [c for c in rules.columns if c not in ("property", "value")]
    plain = [f.name for f in df.schema.fields if f.dataType.simpleString() in
             ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date")
             or f.dataType.simpleString().startswith(("decimal", "timestamp"))]
    pairs = F.array(*[F.struct(F.lit(c).alias("property"), F.col(f"`{c}`").cast("string").alias("value")) for c in plain])
    long = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.inline(pairs))
    wanted = rules.select(F.col("property"), F.col("value"), F.struct(*[F.col(f"`{c}`") for c in style_cols]).alias("_style")) if style_cols \
        else rules.select("property", "value", F.struct(F.lit(1)).alias("_style"))
    out = long.join(wanted, ["property", "value"])
    if exclusive:
        out = out.groupBy("_row").agg(F.min_by(F.struct("property", "_style"), F.struct("property", "value")).alias("_best")) \
                 .select("_row", "_best.property", "_best._style")
    return out.select("_row.*", F.col("property").alias("rule_property"), *[F.col(f"_style.`{c}`").alias(c) for c in style_cols])


def dynamic_style(df: DataFrame, **exprs) -> DataFrame:
    """Style values taken from (joined) columns, e.g. ``icon=concat(pylon_icon, '.png')``."""
    return df.select("*", *[as_col(e).alias(n) for n, e in exprs.items()])


def _hex(c: Column, i: int) -> Column:
    return F.conv(F.substring(c, 2 + 2 * i, 2), 16, 10).cast("double")


def colour_map(value, stops: Sequence[tuple[float, str, float]]) -> Column:
    """``stops = [(quantity, '#RRGGBB', opacity), …]`` ascending → struct(colour, opacity).

    Between stops the RGB channels and opacity are interpolated linearly; below
    the first / above the last stop the end colour is used; NULL stays NULL.
    """
    v = as_col(value).cast("double")
    expr_c = expr_o = None
    first_q, first_c, first_o = stops[0]
    last_q, last_c, last_o = stops[-1]
    branches = [(v <= first_q, F.lit(first_c.upper()), F.lit(float(first_o)))]
    for (q0, c0, o0), (q1, c1, o1) in zip(stops, stops[1:]):
        if q1 == q0:
            continue
        t = (v - q0) / (q1 - q0)
        chans = []
        for i in range(3):
            a, b = int(c0[1 + 2 * i:3 + 2 * i], 16), int(c1[1 + 2 * i:3 + 2 * i], 16)
            chans.append(F.lpad(F.upper(F.hex(F.round(F.lit(float(a)) + (b - a) * t).cast("int"))), 2, "0"))
        branches.append((v <= q1, F.concat(F.lit("#"), *chans), F.lit(float(o0)) + (float(o1) - float(o0)) * t))
    for cond, c, o in branches:
        expr_c = F.when(cond, c) if expr_c is None else expr_c.when(cond, c)
        expr_o = F.when(cond, o) if expr_o is None else expr_o.when(cond, o)
    expr_c = expr_c.when(v.isNotNull(), F.lit(last_c.upper()))
    expr_o = expr_o.when(v.isNotNull(), F.lit(float(last_o)))
    return F.struct(expr_c.alias("colour"), expr_o.alias("opacity"))
