"""Graph queries over the quad table, as DataFrame operators (Q1-Q9, Q11-Q13).

A *binding* DataFrame has one column per variable (``?x`` → column ``x``).  When a
variable is bound in object position its term details travel along as
``x__k`` (kind), ``x__dt`` (datatype) and ``x__l`` (language), so literals with
the same lexical form but different types never join, and ``construct`` can
rebuild the exact term.

Patterns are evaluated as one filtered scan of the quad table each (constant
``p``/``o``/``g`` become pushed-down predicates) and equi-joined on shared
variables; Catalyst/AQE choose broadcast vs. sort-merge from the real sizes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.functions import terms
from geoweave.operators.mapping import QUAD_COLUMNS

AUX = ("__k", "__dt", "__l")


@dataclass(frozen=True)
class Lit:
    """A literal constant in a pattern or template."""
    value: str
    dtype: str | None = None
    lang: str | None = None


Term = str | Lit
Pattern = tuple  # (s, p, o) or (s, p, o, g)


def is_var(t) -> bool:
    return isinstance(t, str) and t.startswith("?")


def vname(t: str) -> str:
    return t[1:]


def _iri(t: str, prefixes) -> str:
    return terms.expand_prefix(t, prefixes)


def _scan(quads: DataFrame, pat: Pattern, prefixes, subject_vars: set[str]) -> DataFrame:
    s, p, o = pat[:3]
    g = pat[3] if len(pat) > 3 else None
    cond = F.lit(True)
    cols: dict[str, Column] = {}
    checks: list[Column] = []

    def bind(term, col, is_object=False):
        nonlocal cond
        if term is None:
            return
        if is_var(term):
            name = vname(term)
            if name in cols:
                checks.append(cols[name] == F.col(col))
                return
            cols[name] = F.col(col)
            if is_object:
                cols[name + "__k"] = F.col("o_kind")
                cols[name + "__dt"] = F.col("o_dtype")
                cols[name + "__l"] = F.col("o_lang")
                if name in subject_vars:
                    cond = cond & (F.col("o_kind") != "literal")
        elif isinstance(term, Lit):
            cond = cond & (F.col(col) == term.value) & (F.col("o_kind") == "literal")
            cond = cond & (F.col("o_dtype").eqNullSafe(F.lit(_iri(term.dtype, prefixes) if term.dtype else None)))
            if term.lang:
                cond = cond & (F.col("o_lang") == term.lang)
        else:
            cond = cond & (F.col(col) == _iri(term, prefixes))
            if is_object:
                cond = cond & (F.col("o_kind") != "literal")

    bind(g, "g")
    bind(s, "s")
    bind(p, "p")
    bind(o, "o", is_object=True)
    scan = quads.where(cond)
    for c in checks:
        scan = scan.where(c)
    return scan.select(*[c.alias(n) for n, c in cols.items()])


def _join_bindings(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    shared = [c for c in a.columns if c in b.columns and not c.endswith(AUX)]
    if not shared:
        raise ValueError("patterns share no variable: refusing a cross product")
    conds = []
    for v in shared:
        conds.append(a[v] == b[v])
        for aux in AUX:
            if v + aux in a.columns and v + aux in b.columns:
                conds.append(a[v + aux].eqNullSafe(b[v + aux]))
    joined = a.join(b, reduce(lambda x, y: x & y, conds), how)
    # shared variables (and their term details) come from the left side, which is never NULL-extended
    rest = [b[c] for c in b.columns if c not in a.columns]
    return joined.select(*[a[c] for c in a.columns], *rest)


def bgp(quads: DataFrame, patterns: Sequence[Pattern], prefixes: Mapping[str, str] | None = None) -> DataFrame:
    """Q1: basic graph pattern → bindings.

    Patterns with more constants go first (most selective scan); each next
    pattern must share a variable with what is already joined (no cross joins).
    """
    subject_vars = {vname(p[0]) for p in patterns if is_var(p[0])} | {vname(p[1]) for p in patterns if is_var(p[1])}
    scans = [(_scan(quads, p, prefixes, subject_vars), p) for p in patterns]
    order = sorted(range(len(scans)), key=lambda i: -sum(1 for t in patterns[i][:3] if not is_var(t)))
    first = order.pop(0)
    acc = scans[first][0]
    while order:
        for k, i in enumerate(order):
            if set(acc.columns) & set(scans[i][0].columns):
                acc = _join_bindings(acc, scans[i][0])
                order.pop(k)
                break
        else:
            raise ValueError("disconnected graph pattern: refusing a cross product")
    return acc


def optional(left: DataFrame, right: DataFrame, maybe: Sequence[str] = ()) -> DataFrame:
    """Left outer join on the shared variables.

    ``maybe`` names shared variables that an earlier OPTIONAL may have left unbound.  An unbound variable is compatible with any
    value and takes the right side's: solutions are split by which of these they bind, each kind has its own equi-join.
    """
    names = [v.lstrip("?") for v in maybe if v.lstrip("?") in left.columns and v.lstrip("?") in right.columns]
    if not names:
        return _join_bindings(left, right, "left")
    out = None
    for bound in product((True, False), repeat=len(names)):
        free = [v for v, b in zip(names, bound, strict=True) if not b]
        kind = left.where(reduce(lambda x, y: x & y, [F.col(v).isNotNull() == F.lit(b) for v, b in zip(names, bound, strict=True)]))
        taken = [c for v in free for c in (v, *(v + a for a in AUX)) if c in left.columns]  # null on this side: the right one's stand in
        joined = _join_bindings(kind.drop(*taken), right, "left")
        part = joined.select(*[F.col(c) if c in joined.columns else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns],
                             *[F.col(c) for c in right.columns if c not in left.columns])
        out = part if out is None else out.unionByName(part)
    return out


def bind(df: DataFrame, var: str, expr: Column) -> DataFrame:
    """Q3: ``BIND(expr AS ?var)``."""
    return df.withColumn(var.lstrip("?"), expr)


def values(df: DataFrame, var: str, items: Sequence[str], prefixes: Mapping[str, str] | None = None) -> DataFrame:
    """Inline ``VALUES ?var {…}``; the list lives on the driver, so its size is known."""
    name = var.lstrip("?")
    spark = df.sparkSession
    v = spark.createDataFrame([(_iri(i, prefixes),) for i in items], f"`{name}` string")
    return df.join(F.broadcast(v), name, "left_semi")


def path(quads: DataFrame, subject: str, predicates: Sequence[str], obj: str,
         prefixes: Mapping[str, str] | None = None) -> DataFrame:
    """Q5: sequence path ``s p1/p2/… o``; intermediate variables are dropped."""
    mids = [f"?__m{i}" for i in range(len(predicates) - 1)]
    nodes = [subject, *mids, obj]
    pats = [(nodes[i], predicates[i], nodes[i + 1]) for i in range(len(predicates))]
    out = bgp(quads, pats, prefixes)
    drop = [c for c in out.columns if c.startswith("__m")]
    return out.drop(*drop)


def select(df: DataFrame, vars_: Sequence[str], limit: int | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """Q6: projection (+ optional ``LIMIT``; give ``order_by`` for a deterministic one)."""
    out = df.select(*[v.lstrip("?") for v in vars_])
    if order_by:
        out = out.orderBy(*[o.lstrip("?") for o in order_by])
    return out.limit(limit) if limit is not None else out


def _term_cols(df: DataFrame, t: Term, prefixes, position: str) -> tuple[Column, Column, Column, Column]:
    if is_var(t):
        n = vname(t)
        if n + "__k" in df.columns:
            return F.col(n), F.col(n + "__k"), F.col(n + "__dt"), F.col(n + "__l")
        return F.col(n), F.lit("iri"), F.lit(None).cast("string"), F.lit(None).cast("string")
    if isinstance(t, Lit):
        return (F.lit(t.value), F.lit("literal"), F.lit(_iri(t.dtype, prefixes) if t.dtype else None).cast("string"),
                F.lit(t.lang).cast("string"))
    if isinstance(t, Column):
        return t, F.lit("iri"), F.lit(None).cast("string"), F.lit(None).cast("string")
    return F.lit(_iri(t, prefixes)), F.lit("iri"), F.lit(None).cast("string"), F.lit(None).cast("string")


def construct(bindings: DataFrame, templates: Sequence[Pattern], prefixes: Mapping[str, str] | None = None,
              graph: str | None = None, distinct: bool = True) -> DataFrame:
    """Q7: instantiate triple templates for every binding row (one scan, explode)."""
    out = _instances(bindings, [F.struct(*_quad(bindings, t, prefixes, graph)) for t in templates])
    return out.distinct() if distinct else out


def _quad(bindings: DataFrame, template: Pattern, prefixes, graph: str | None) -> list[Column]:
    """The seven quad columns of one template over the bindings."""
    s, p, o = template[:3]
    g = template[3] if len(template) > 3 else graph
    ov, ok, odt, ol = _term_cols(bindings, o, prefixes, "o")
    gv = _term_cols(bindings, g, prefixes, "g")[0] if g is not None else F.lit(None)
    sv, pv = _term_cols(bindings, s, prefixes, "s")[0], _term_cols(bindings, p, prefixes, "p")[0]
    parts = [gv, sv, pv, ov, ok, odt, ol]
    return [c.cast("string").alias(n) for c, n in zip(parts, QUAD_COLUMNS, strict=True)]


def _instances(bindings: DataFrame, items: list[Column]) -> DataFrame:
    out = bindings.select(F.explode(F.array(*items)).alias("t")).select("t.*")
    return out.where(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull())


def changes(bindings: DataFrame, delete: Sequence[Pattern], insert: Sequence[Pattern],
            prefixes: Mapping[str, str] | None = None, graph: str | None = None) -> DataFrame:
    """Quads that an update takes away (``added`` false) and brings (true), both template sets from one pass over the bindings."""
    items = [F.struct(*_quad(bindings, t, prefixes, graph), F.lit(added).alias("added"))
             for added, templates in ((False, delete), (True, insert)) for t in templates]
    return _instances(bindings, items)


def apply_changes(quads: DataFrame, changed: DataFrame, tasks: int | None = None) -> DataFrame:
    """The quad table after ``changed``, as a set: one aggregation by quad (NULL-safe, combined before the shuffle).

    A quad both deleted and inserted stays, as in SPARQL Update, where the deletions come first; deleting an absent quad does nothing.
    With ``tasks`` the quads are dealt out to as many before they are aggregated, so that a task's share can be bounded.
    """
    rows = quads.select(*QUAD_COLUMNS, F.lit(None).cast("boolean").alias("added")).unionByName(changed)
    if tasks:
        rows = rows.repartition(tasks, *QUAD_COLUMNS)
    last = rows.groupBy(*QUAD_COLUMNS).agg(F.max("added").alias("added"))
    return last.where(F.coalesce("added", F.lit(True))).select(*QUAD_COLUMNS)


def null_safe_anti(quads: DataFrame, remove: DataFrame) -> DataFrame:
    """Quads not in ``remove`` (all seven columns compared NULL-safely)."""
    r = remove.select(*[F.col(c).alias("_r_" + c) for c in QUAD_COLUMNS])
    cond = reduce(lambda a, b: a & b, [quads[c].eqNullSafe(r["_r_" + c]) for c in QUAD_COLUMNS])
    return quads.join(r, cond, "left_anti")


def modify(quads: DataFrame, delete: Sequence[Pattern], insert: Sequence[Pattern], where: Sequence[Pattern],
           prefixes: Mapping[str, str] | None = None, graph: str | None = None, tasks: int | None = None) -> DataFrame:
    """Q8: ``DELETE {…} INSERT {…} WHERE {…}`` → the new quad table (set semantics).

    The WHERE bindings are computed against the *old* table and feed both template sets, as SPARQL Update requires.
    ``sources.rdf.update_quad_table`` does the same to a stored table and rewrites only the predicates it touches.
    """
    if not delete and not insert:
        return quads.distinct()
    return apply_changes(quads, changes(bgp(quads, where, prefixes), delete, insert, prefixes, graph), tasks)


def run_rules(quads: DataFrame, rules: Sequence[Mapping], prefixes: Mapping[str, str] | None = None,
              checkpoint: bool = True) -> DataFrame:
    """Q9: each update rule runs once, in order; lineage is cut between rules."""
    from geoweave.session import cut_lineage, tasks_for

    out, tasks = quads, tasks_for(quads)
    for r in rules:
        out = modify(out, r.get("delete", []), r.get("insert", []), r["where"], prefixes, r.get("graph"), tasks)
        if checkpoint:
            out = cut_lineage(out)
    return out


def graph_filter(quads: DataFrame, g: str | None) -> DataFrame:
    """Q11: restrict to one named graph (``None`` = default graph)."""
    return quads.where(F.col("g").isNull() if g is None else F.col("g") == g)


def shape_json(bindings: DataFrame, anchor: str, fields: Mapping[str, Mapping], lang: str | None = None) -> DataFrame:
    """Q13: nest flat bindings under their anchor id as JSON.

    ``fields``: ``{out_name: {"var": name, "required": bool}}``.  Optional fields
    may be missing; rows without a required field are dropped; with ``lang`` the
    language-tagged values are filtered to it and the tag is hidden.
    """
    df = bindings
    for name, spec in fields.items():
        v = spec["var"].lstrip("?")
        if spec.get("required"):
            df = df.where(F.col(v).isNotNull())
        if lang and v + "__l" in df.columns:
            df = df.where(F.col(v + "__l").isNull() | (F.col(v + "__l") == lang))
    a = anchor.lstrip("?")
    aggs = [F.array_sort(F.collect_set(F.col(spec["var"].lstrip("?")))).alias(name) for name, spec in fields.items()]
    grouped = df.groupBy(a).agg(*aggs)
    return grouped.select(F.col(a).alias("id"), F.to_json(F.struct(F.col(a).alias("id"), *[F.col(n) for n in fields])).alias("json"))
