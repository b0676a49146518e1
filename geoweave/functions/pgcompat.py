"""Column helpers with PostgreSQL semantics (the reference runs its SQL on PostgreSQL).

All helpers return Columns built from Spark built-ins, so they stay inside
whole-stage codegen.  Semantics that differ between Spark and PostgreSQL are
handled explicitly (NULL-ignoring concat, SUBSTRING with start < 1, lenient
TO_NUMBER, percent-encoding).
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoweave.functions.util import as_col


# --- strings ----------------------------------------------------------------

def pg_concat(*cols) -> Column:
    """PostgreSQL ``CONCAT`` — NULL arguments are ignored (Spark ``concat`` gives NULL)."""
    return F.concat_ws("", *[as_col(c).cast("string") for c in cols])


def pg_substring(col, start: int, length: int | None = None) -> Column:
    """PostgreSQL ``SUBSTRING(c, start, len)``.

    Positions before 1 still consume length: ``SUBSTRING('abcdef', 0, 5)`` = ``'abcd'``.
    """
    c = as_col(col)
    first = max(start, 1)
    if length is None:
        return F.substring(c, first, 2**31 - 1)
    n = max(start + length - first, 0)
    return F.substring(c, first, n)


def trim_leading(col, chars: str = " ") -> Column:
    """``TRIM(LEADING chars FROM c)``."""
    return F.ltrim(as_col(col), F.lit(chars))


def iri_encode(col) -> Column:
    """Percent-encode everything outside RFC 3986 *unreserved* (``A-Za-z0-9-._~``).

    Spark's ``url_encode`` is form encoding (space → ``+``, keeps ``*``, encodes ``~``);
    the three fix-ups give the IRI-safe form used for IRI templates.
    """
    e = F.url_encode(as_col(col).cast("string"))
    e = F.replace(e, F.lit("+"), F.lit("%20"))
    e = F.replace(e, F.lit("*"), F.lit("%2A"))
    return F.replace(e, F.lit("%7E"), F.lit("~"))


def replace_chain(col, pairs: Iterable[tuple[str, str]]) -> Column:
    """Nested ``REPLACE`` (the mapping files percent-encode space and ``/`` this way)."""
    c = as_col(col)
    for find, repl in pairs:
        c = F.replace(c, F.lit(find), F.lit(repl))
    return c


def split_part(col, delimiter: str, n: int) -> Column:
    """``split_part(c, delim, n)`` (1-based, empty string when out of range)."""
    return F.split_part(as_col(col), F.lit(delimiter), F.lit(n))


def json_path_text(col, path: str) -> Column:
    """``c -> … ->> …`` on a JSON text column (``$.a[0].b`` path syntax)."""
    return F.get_json_object(as_col(col), path)


def pg_to_number(col, fmt: str = "99G999D9S") -> Column:
    """Lenient ``TO_NUMBER``: plain decimals first, then the grouped/signed format."""
    c = F.trim(as_col(col).cast("string"))
    return F.coalesce(c.try_cast("double"), F.try_to_number(c, F.lit(fmt)).cast("double"))


def to_int(col) -> Column:
    """Text → int; unparsable text gives NULL (Spark 4 plain casts raise under ANSI)."""
    return F.trim(as_col(col).cast("string")).try_cast("int")


def string_replace(col, find: str, replacement: str) -> Column:
    """``fn:string_replace``; ``/re/`` (slash-delimited) is a regex, otherwise literal."""
    c = as_col(col)
    m = re.fullmatch(r"/(.*)/", find)
    if m:
        return F.regexp_replace(c, m.group(1), replacement)
    return F.replace(c, F.lit(find), F.lit(replacement))


def string_trim(col) -> Column:
    """``fn:string_trim``."""
    return F.trim(as_col(col))


# --- path helpers (X15) -------------------------------------------------------

def file_name(col) -> Column:
    """Last path segment."""
    return F.regexp_extract(as_col(col), r"([^/\\]*)$", 1)


def strip_extension(col) -> Column:
    """File name without extension; a dot at index 0 (hidden file) is kept."""
    return F.regexp_replace(file_name(col), r"^(.+)\.[^.]*$", "$1")


def replace_extension(col, ext: str) -> Column:
    """Swap the extension of a path (``ext`` with or without the leading dot)."""
    ext = ext if ext.startswith(".") else "." + ext
    c = as_col(col)
    return F.when(F.regexp_like(file_name(c), F.lit(r"^.+\.[^.]*$")),
                  F.regexp_replace(c, r"\.[^./\\]*$", ext.replace("$", r"\$"))).otherwise(F.concat(c, F.lit(ext)))


def sanitise_filename(col) -> Column:
    """Every character outside ``[A-Za-z0-9_.]`` becomes ``_`` (``+Hello()World-123.csv`` → ``_Hello__World_123.csv``)."""
    return F.regexp_replace(file_name(col), r"[^\w.]", "_")


def fix_slashes(col, leading: bool, trailing: bool) -> Column:
    """Normalise edge slashes: exactly one (or none) at each end; empty path → ``'/'`` if any slash wanted."""
    core = F.regexp_replace(as_col(col), r"^/+|/+$", "")
    lead = "/" if leading else ""
    trail = "/" if trailing else ""
    body = F.concat(F.lit(lead), core, F.lit(trail))
    edge = "/" if (leading or trailing) else ""
    return F.when(core == "", F.lit(edge)).otherwise(body)


# --- dates and times (X16-X18) ------------------------------------------------

def _defaulted_pattern(fmt: str) -> tuple[str, str]:
    """Complete a Java-style pattern so missing fields default (month/day → 1, time → 0).

    Returns (pattern, suffix) where ``suffix`` is appended to every value.
    """
    letters = set(re.sub(r"'[^']*'", "", fmt))
    pattern, suffix = fmt, ""
    for field, filler in (("M", ("MM", "01")), ("d", ("dd", "01")), ("H", ("HH", "00")),
                          ("m", ("mm", "00")), ("s", ("ss", "00"))):
        if field not in letters and not (field == "H" and "h" in letters):
            pattern += "|" + filler[0]
            suffix += "|" + filler[1]
    return pattern, suffix


def parse_datetime(col, fmt: str, tz: str | None = None) -> Column:
    """Parse text with a Java-style pattern; missing month/day → 1, time fields → 0.

    With ``tz`` the text is local time in that zone; without it an offset in the
    text is honoured and UTC is assumed otherwise.  Returns a ``TIMESTAMP`` (an
    instant; shown in the session time zone).
    """
    c = as_col(col).cast("string")
    has_offset = bool(set(re.sub(r"'[^']*'", "", fmt)) & set("XxZO"))
    pattern, suffix = _defaulted_pattern(fmt)
    value = F.concat(c, F.lit(suffix)) if suffix else c
    if has_offset and tz is None:
        return F.try_to_timestamp(value, F.lit(pattern))
    local = F.to_timestamp_ntz(value, F.lit(pattern))
    zone = tz or "UTC"
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local).cast("timestamp_ntz")


def label_cuts(template: str) -> list[int]:
    """Three places at which a date label is cut: each lies one field further, a field being the longest
    run of one character that another run follows (the last run of a template never counts)."""
    cuts, at = [], 0
    for _ in range(3):
        runs = [len(m[0]) for m in re.finditer(r"(.)\1*", template[at:])]
        at += max(runs[:-1], default=0)
        cuts.append(at)
    return cuts


def split_date_label(col, template: str) -> Column:
    """``20240203`` → ``2024/02/03``; > 8 chars → ``y/m/d:rest``; ≤ 6 → ``y/m``.

    The number of cuts follows the value's length; a template of one repeated character makes none.
    """
    c = as_col(col).cast("string")
    if len(set(template)) == 1:
        return c
    cuts = label_cuts(template)

    def cut_at(places: list[int], marks: str) -> Column:
        starts = [0, *places]
        parts = [F.substring(c, x + 1, y - x) for x, y in zip(starts, places, strict=False)] + [F.substr(c, F.lit(starts[-1] + 1))]
        return F.concat(*[x for part, mark in zip(parts, [*marks, ""], strict=True) for x in (part, F.lit(mark))])

    n = F.length(c)
    return F.when(n > 8, cut_at(cuts, "//:")).when(n > 6, cut_at(cuts[:2], "//")).otherwise(cut_at(cuts[:1], "/"))


def time_from_name(col, regex: str, fmt: str, tz: str | None = None) -> Column:
    """Extract a timestamp from a file name (e.g. ``.*([0-9]{10}).*`` + ``yyyyMMddHH``)."""
    return parse_datetime(F.regexp_extract(as_col(col), regex, 1), fmt, tz)


# --- ids (X19) ------------------------------------------------------------------

def stable_uuid(*cols, prefix: str = "") -> Column:
    """Deterministic uuid-shaped id from the given key columns (reruns and oracles agree)."""
    h = F.sha1(F.concat_ws("\u0001", *[as_col(c).cast("string") for c in cols]))
    shaped = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                         F.substring(h, 17, 4), F.substring(h, 21, 12))
    return F.concat(F.lit(prefix), shaped) if prefix else shaped
