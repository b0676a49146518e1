"""Transform stages rendered as nested DuckDB sub-selects (oracle side only)."""

from __future__ import annotations

import math

from geoweave.functions.crs import stages


class _S:
    """SQL expression text with arithmetic operators (oracle side only)."""

    def __init__(self, t):
        self.t = t if isinstance(t, str) else repr(float(t))

    def _b(self, o, op, rev=False):
        o = o if isinstance(o, _S) else _S(o)
        return _S(f"({o.t} {op} {self.t})" if rev else f"({self.t} {op} {o.t})")

    def __add__(self, o): return self._b(o, "+")  # noqa: E704
    def __radd__(self, o): return self._b(o, "+", True)  # noqa: E704
    def __sub__(self, o): return self._b(o, "-")  # noqa: E704
    def __rsub__(self, o): return self._b(o, "-", True)  # noqa: E704
    def __mul__(self, o): return self._b(o, "*")  # noqa: E704
    def __rmul__(self, o): return self._b(o, "*", True)  # noqa: E704
    def __truediv__(self, o): return self._b(o, "/")  # noqa: E704
    def __rtruediv__(self, o): return self._b(o, "/", True)  # noqa: E704
    def __neg__(self): return _S(f"(-{self.t})")  # noqa: E704


def _fn(name):
    return lambda *a: _S(f"{name}(" + ", ".join((x if isinstance(x, _S) else _S(x)).t for x in a) + ")")


class SqlMath:
    sin, cos, tan, sqrt, atan, atan2, ln, exp, radians, degrees = (
        _fn("sin"), _fn("cos"), _fn("tan"), _fn("sqrt"), _fn("atan"), _fn("atan2"), _fn("ln"), _fn("exp"),
        _fn("radians"), _fn("degrees"))
    pi = math.pi


def sql_transform(base_sql: str, keys: list[str], x: str, y: str, src: int, dst: int, z: str = "0.0") -> str:
    """DuckDB SQL: ``keys`` + transformed ``x, y, z`` of ``base_sql`` rows, one sub-select per stage."""
    k = ", ".join(keys)
    sql = f"SELECT {k}, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, CAST({z} AS DOUBLE) AS z, CAST({z} AS DOUBLE) AS z0 FROM ({base_sql})"
    for st in stages(src, dst):
        out = st(lambda n: _S(n), SqlMath)
        if "z0" not in out:
            out["z0"] = _S("z0")
        cols = ", ".join(f"{(e if isinstance(e, _S) else _S(e)).t} AS {name}" for name, e in out.items())
        sql = f"SELECT {k}, {cols} FROM ({sql})"
    return sql
