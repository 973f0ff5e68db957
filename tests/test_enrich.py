import pytest

from quakes.functions.rules import KEYWORDS_BY_CONTINENT, OCEAN_WORDS
from quakes.operators.enrich import continent_lookup, country_lookup, map_continent, map_country

FLAT = [(kw, cont) for cont, kws in KEYWORDS_BY_CONTINENT.items() for kw in kws]
SORTED = sorted(range(len(FLAT)), key=lambda i: -len(FLAT[i][0]))


def keyword_only(s):
    """Brute force of the keyword / ocean / default fallback (no gazetteer)."""
    sl = str(s).lower()
    for i in SORTED:
        if FLAT[i][0] in sl:
            return FLAT[i][1]
    for w in OCEAN_WORDS:
        if w in sl:
            return "Ocean/Other"
    return "unknown"


EXPECTED = {
    # keyword fallback (two-letter keys match inside words)
    "northern Mid-Atlantic Ridge": "North America",
    "North Pacific Ocean": "North America",
    "Coral Sea": "North America",
    "Norwegian Sea": "North America",
    "Labrador Sea": "North America",
    "Carlsberg Ridge": "North America",
    "Molucca Sea": "North America",
    "Southwest Indian Ridge": "Asia",
    "Mid-Indian Ridge": "Asia",
    "Southern Mid-Atlantic Ridge": "Ocean/Other",
    "South Pacific Ocean": "Ocean/Other",
    "Bering Sea": "Ocean/Other",
    "Banda Sea": "Ocean/Other",
    "Pacific-Antarctic Ridge": "Ocean/Other",
    "Drake Passage": "Antarctica",
    "Kahramanmaras": "Asia",
    "Loyalty Islands": "Oceania",
    "Ascension Island": "Africa",
    "American Samoa Islands": "Oceania",
    "South Sandwich Islands region": "Antarctica",
    # gazetteer first (keywords alone would say North America / unknown)
    "Singapore": "Asia",
    "Andorra": "Europe",
    "Slovenia": "Europe",
    "Japan": "Asia",
    "CA": "North America",
    "Chile": "South America",
    "Russia": "Europe",  # contained in "Russian Federation"
    "Kingdom of Tonga": "Oceania",  # official name
    "Reunion": "Africa",  # accent-folded match of "Réunion"
    "Cote d'Ivoire": "Africa",
    "Türkiye": "Asia",
    "": "unknown",
}


def test_continent_lookup_cases(spark):
    df = spark.createDataFrame([(k,) for k in EXPECTED] + [(None,)], "country string")
    got = {r.country: r.continent for r in continent_lookup(df).collect()}
    assert got.pop(None) == "unknown"
    assert got == EXPECTED


def test_keyword_fallback_matches_brute_force(spark):
    # texts no ISO name or code can match, so only the keyword rules decide
    texts = ["Gulf of Alaska", "Fox Islands, Aleutian Islands", "off the coast of Oregon", "Greenland Sea",
             "Central Mid-Atlantic Ridge", "Owen Fracture Zone region", "Timor Sea", "xyz", "Kuril Islands",
             "Philippine Islands region", "Tonga region", "Mona Passage", "Davis Strait", "Java Sea"]
    df = spark.createDataFrame([(t,) for t in texts], "country string")
    got = {r.country: r.continent for r in continent_lookup(df).collect()}
    for t in texts:
        assert got[t] == keyword_only(t), t


def test_map_back_is_broadcast_and_null_is_unknown(spark):
    facts = spark.createDataFrame(
        [(1, "Japan"), (2, "Banda Sea"), (3, None), (4, "Japan")], "id int, country string"
    )
    lk = continent_lookup(facts.select("country"))
    out = map_continent(facts, lk)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
    got = {r.id: r.continent for r in out.collect()}
    assert got == {1: "Asia", 2: "Ocean/Other", 3: "unknown", 4: "Asia"}


def test_country_lookup_rewrites_once_per_text(spark):
    facts = spark.createDataFrame(
        [(1, "Burma (Myanmar) Earthquake"), (2, "12 km NNE of Ta"), (3, None), (4, "Peru")], "id int, country string"
    )
    lk = country_lookup(facts.select("country"))
    got = {r.id: (r.country, r.continent) for r in map_country(facts, lk).collect()}
    assert got == {
        1: ("Myanmar", "Asia"),
        2: ("American Samoa Islands", "Oceania"),
        3: (None, "unknown"),
        4: ("Peru", "South America"),
    }


@pytest.mark.parametrize("rows", [0, 3])
def test_lookup_join_falls_back_to_shuffle_above_the_bound(spark, rows):
    facts = spark.createDataFrame([(1, "Japan"), (2, "Peru")], "id int, country string")
    lk = continent_lookup(facts.select("country"))
    lk = spark.createDataFrame(lk.collect(), lk.schema)  # stored: its own joins are not in the plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = map_continent(facts, lk, max_broadcast_rows=rows)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("BroadcastHashJoin" in plan) == (rows > 0)
    assert sorted(r.continent for r in out.collect()) == ["Asia", "South America"]
