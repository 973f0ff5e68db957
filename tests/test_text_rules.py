import re

import pytest
from pyspark.sql import functions as F

from quakes.functions.rules import COUNTRY_REWRITES
from quakes.functions.text import apply_rewrites, last_comma_part, strip_ws


def _py_country(place):
    """The rule text applied the way the catalogue's pandas code does."""
    if place is None:
        return None
    place = place.strip()
    m = re.search(r",\s*([^,]+)$", place)
    c = m.group(1) if m else place
    for pat, repl in COUNTRY_REWRITES:
        c = re.sub(pat, repl, c)
    return c


SAMPLES = [
    "12 km NE of Town 5, Japan",
    "  padded place\t",
    "　ideographic space ",
    "a, b, c",
    "a,   spaced",
    "no comma here",
    "Off the East Coast of the North Island of New Zealand",
    "north of Ascension Island",
    "WEST OF MACQUARIE ISLAND",
    "Southeast of the Loyalty Islands",
    "east of the South Sandwich Islands",
    "south of the Kermadec Islands",
    "southeast of Easter Island",
    "off the west coast of the South Island of New Zealand",
    "2021 South Sandwich Islands Earthquake",
    "12 km NNE of Ta",
    "1234 km nne of TA",
    "km NNE of Ta",
    "New Zealand earthquake",
    "Alaska Earthquake",
    "Kahramanmaras earthquake sequence",
    "Lake Almanor Earthquake",
    "Japan earthquake",
    "New Jersey earthquake",
    "Texas earthquake",
    "Nevada earthquake",
    "California earthquake",
    "2025 Southern Tibetan Plateau Earthquake",
    "Burma (Myanmar) Earthquake",
    "2025 Drake Passage Earthquake",
    "Russia Earthquake",
    "2025 Southern Drake Passage Earthquake",
    "Taiwan earthquake",
    "2025 Hubbard Glacier Earthquake",
    "Louisiana earthquake",
    "\u0661\u0662 km NNE of Ta",
    "x,\u3000Japan earthquake",
    "y,\xa0\x1cChile",
    "x, Alaska earthquake",
    "Alaska earthquake swarm",
    "",
    None,
]


@pytest.mark.parametrize("rewrite_rows", [True])
def test_country_rules_match_python_semantics(spark, rewrite_rows):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "place string")
    out = df.select(
        "place", apply_rewrites(last_comma_part(strip_ws(F.col("place")))).alias("country")
    ).collect()
    for row in out:
        assert row.country == _py_country(row.place), row.place


def test_strip_matches_python_strip(spark):
    texts = [" a ", "\t\nb\r\x0b\x0c", "\x1cc\x1f", "\x85d\xa0", " e　", "f", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(strip_ws(F.col("t"))).collect()]
    assert got == [None if t is None else t.strip() for t in texts]
