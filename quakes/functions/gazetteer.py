"""Country gazetteer (ISO 3166-1 names and codes) for the continent lookup.

The gazetteer is a fixed, bounded table (249 countries), so it is always safe
to broadcast.  Matching is done as a Spark join in ``quakes.operators.enrich``:
texts and names are compared lowercased and accent-folded; an exact hit on
a code or a name scores 50, a country whose name (or official
name) contains the text scores ``max(5, 30 - 2 * position)``; the best score
wins, ties go to the earlier country in alpha-3 order.
"""

from __future__ import annotations

import csv
import functools
import os

from quakes.functions.text import fold_accents_py

CONTINENT_NAMES = {
    "AF": "Africa",
    "AN": "Antarctica",
    "AS": "Asia",
    "EU": "Europe",
    "NA": "North America",
    "OC": "Oceania",
    "SA": "South America",
}

EXACT_POINTS = 50
PARTIAL_TOP = 30
PARTIAL_FLOOR = 5

_PATH = os.path.join(os.path.dirname(__file__), "data", "iso3166.psv")


@functools.lru_cache(maxsize=1)
def countries() -> list[dict]:
    """Rows in alpha-3 order, with ``ord`` and the continent name (or None)."""
    with open(_PATH, encoding="utf-8") as f:
        lines = [ln for ln in f if not ln.startswith("#")]
    # keep_default_na does not apply: csv keeps "NA" (Namibia) as text.
    rows = list(csv.DictReader(lines, delimiter="|"))
    rows.sort(key=lambda r: r["alpha3"])
    out = []
    for i, r in enumerate(rows):
        out.append(
            {
                "ord": i,
                "alpha2": r["alpha2"],
                "alpha3": r["alpha3"],
                "name": r["name"],
                "official_name": r["official_name"] or None,
                "common_name": r["common_name"] or None,
                "continent": CONTINENT_NAMES.get(r["continent"]) if r["continent"] else None,
            }
        )
    return out


def _key(text: str | None) -> str | None:
    return fold_accents_py(text.lower()) if text else None


def gazetteer_rows() -> list[tuple]:
    """(ord, alpha2, code2, code3, name_l, official_l, common_l, continent);
    keys lowercased and accent-folded, as the matched text is."""
    out = []
    for r in countries():
        out.append(
            (
                r["ord"],
                r["alpha2"],
                r["alpha2"].lower(),
                r["alpha3"].lower(),
                _key(r["name"]),
                _key(r["official_name"]),
                _key(r["common_name"]),
                r["continent"],
            )
        )
    return out


GAZETTEER_DDL = (
    "g_ord INT, g_alpha2 STRING, g_code2 STRING, g_code3 STRING, g_name STRING, "
    "g_official STRING, g_common STRING, g_continent STRING"
)
