"""Fixed values that must equal the reference's example lookups (stated plainly, natural order).

Both the Spark queries and the DuckDB oracles are generated from these lists.
"""

from __future__ import annotations

# Crop land-use labels (lucode, label), first rows of the example lookup.
CROP_LABELS = [
    ("AC01", "Spring Barley"),
    ("AC03", "Beet"),
    ("AC04", "Borage"),
    ("AC05", "Buckwheat"),
    ("AC06", "Canary Seed"),
    ("AC07", "Carrot"),
    ("AC09", "Chicory"),
    ("AC10", "Daffodil"),
    ("AC14", "Hemp"),
    ("AC15", "Lettuce"),
    ("AC16", "Spring Linseed "),
    ("AC17", "Maize"),
]

# Crop colours (lucode, colour); an empty colour cell loads as NULL.
CROP_COLOURS = [
    ("AC01", "#a7ab3d"),
    ("AC03", "#ff0000"),
    ("AC10", "#efd45c"),
    ("AC16", "#6c55ca"),
    ("AC17", "#ff9300"),
    ("AC19", "#f8dbad"),
    ("AC20", "#ffceff"),
    ("AC04", None),
    ("AC05", None),
    ("AC06", None),
    ("AC07", None),
]

# Line styling per voltage level
# (voltage_level, line_colour, outline_colour, line_width, outline_width, pylon_icon, icon_size).
LINE_STYLING = [
    ("L", "#ffffff", "#895A5A", "1m", "4m", "pylon_low_icon", "50m"),
    ("M", "#33DBFC", "#895A5A", "2m", "6m", "pylon_medium_icon", "60m"),
    ("H", "#036FFC", "#895A5A", "4m", "8m", "pylon_high_icon", "70m"),
    ("S", "#003479", "#895A5A", "6m", "12m", "pylon_superhigh_icon", "80m"),
]

# Voltage bands (lower bound inclusive, level), highest first.
VOLTAGE_BANDS = [(230, "S"), (35, "H"), (1, "M")]


def sql_values(rows, names) -> str:
    """Rows → a DuckDB ``(VALUES …) t(names)`` derived table (VARCHAR for strings/NULLs)."""
    def lit(v):
        if v is None:
            return "CAST(NULL AS VARCHAR)"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(names)})"
