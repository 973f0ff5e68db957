"""Property tests: generated inputs, Spark result vs a direct definition."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quakes.functions.rules import COUNTRY_REWRITES
from quakes.functions.text import apply_rewrites, last_comma_part, strip_ws
from quakes.operators.pairs import consecutive_pairs, consecutive_pairs_bruteforce

from test_text_rules import _py_country

RULE_TEXTS = [p.replace("(?i)^", "").replace("$", "").replace("\\(", "(").replace("\\)", ")").replace("\\d+", "12")
              for p, _ in COUNTRY_REWRITES]
piece = st.one_of(
    st.text(alphabet=st.characters(codec="utf-8", categories=["L", "N", "Zs", "Cc", "P"]), max_size=12),
    st.sampled_from(RULE_TEXTS + [", ", ",", " \t", "　", "\x85", "Ta", ",\u3000", ",\xa0", ",\x1c ", "\u2028",
                                  "\u0661\u0662 km NNE of Ta", "\u0966 KM nne OF ta"]),
    st.sampled_from(RULE_TEXTS).map(str.upper),
)
place = st.lists(piece, max_size=4).map("".join)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(place, st.none()), min_size=1, max_size=80))
def test_country_rules_on_generated_places(spark, places):
    df = spark.createDataFrame([(p,) for p in places], "place string")
    out = df.select("place", apply_rewrites(last_comma_part(strip_ws(F.col("place")))).alias("c")).collect()
    for r in out:
        assert r.c == _py_country(r.place), repr(r.place)


event = st.tuples(
    st.integers(min_value=0, max_value=30),            # id suffix (duplicates allowed)
    st.one_of(st.none(), st.integers(0, 20_000)),      # seconds after t0 (many ties)
    st.one_of(st.none(), st.floats(-1.0, 1.0)),        # latitude
    st.floats(-1.0, 1.0),                              # longitude
)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(event, min_size=2, max_size=120), st.integers(1, 9))
def test_pairs_on_generated_events(spark, events, slices):
    t0 = dt.datetime(2022, 1, 1)
    rows = [(f"e{i}", None if s is None else t0 + dt.timedelta(seconds=s), lat, lon) for i, s, lat, lon in events]
    # ids are unique per (id, time) only if the generated pairs are; keep the first of exact duplicates
    seen, uniq = set(), []
    for r in rows:
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            uniq.append(r)
    df = spark.createDataFrame(uniq, "id string, time timestamp_ntz, latitude double, longitude double")

    def key(d):
        return sorted((r.prev_id, r.id, r.prev_time, r.time, round(r.distance_km, 6)) for r in d.collect())

    assert key(consecutive_pairs(df, max_km=60.0, max_seconds=900, slices=slices)) == key(
        consecutive_pairs_bruteforce(df, max_km=60.0, max_seconds=900)
    )


from quakes.functions.gazetteer import countries, gazetteer_rows  # noqa: E402
from quakes.functions.rules import OCEAN_WORDS, keyword_rows  # noqa: E402
from quakes.functions.text import fold_accents_py  # noqa: E402
from quakes.operators.enrich import continent_lookup  # noqa: E402

GAZ = gazetteer_rows()
KW = sorted(keyword_rows(), key=lambda r: r[3])


def py_continent(s):
    """The lookup rules stated directly (used only to check the Spark joins)."""
    if s is None:
        return "unknown"
    lc = fold_accents_py(s.lower())
    if lc != "":
        best = None
        for ord_, _a2, code2, code3, name, official, common, cont in GAZ:
            exact = lc in (code2, code3, name, official, common)
            npos = name.find(lc)
            opos = official.find(lc) if official else -1
            if not (exact or npos >= 0 or opos >= 0):
                continue
            part = max(5, 30 - 2 * npos) if npos >= 0 else (max(5, 30 - 2 * opos) if opos >= 0 else 0)
            k = (50 * exact + part, -ord_)
            if best is None or k > best[0]:
                best = (k, cont)
        if best is not None and best[1] is not None:
            return best[1]
    sl = s.lower()
    for _o, kw, cont, _p in KW:
        if kw in sl:
            return cont
    if any(w in sl for w in OCEAN_WORDS):
        return "Ocean/Other"
    return "unknown"


NAMES = [c["name"] for c in countries()] + [c["alpha2"] for c in countries()] + [c["alpha3"] for c in countries()]
WORDS = [r[1] for r in keyword_rows()] + OCEAN_WORDS + ["Réunion", "Cote d'Ivoire", "Türkiye", "ridge", "region"]
latin = st.text(alphabet=st.characters(min_codepoint=0x20, max_codepoint=0x24F, categories=["L", "Zs", "Pd"]),
                max_size=8)
word = st.one_of(st.sampled_from(NAMES), st.sampled_from(WORDS), latin)
country_text = st.lists(word, min_size=0, max_size=3).map(" ".join)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(country_text, st.sampled_from(NAMES), st.none()), min_size=1, max_size=60))
def test_continent_lookup_on_generated_texts(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "country string")
    got = {r.country: r.continent for r in continent_lookup(df).collect()}
    for t in set(texts):
        assert got[t] == py_continent(t), repr(t)



@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(place, st.none()), min_size=1, max_size=80))
def test_last_comma_part_equals_the_regex_on_raw_text(spark, places):
    import re

    from quakes.functions.text import LAST_PART_PATTERN

    py_pat = re.compile(r",\s*([^,]+)$")
    df = spark.createDataFrame([(p,) for p in places], "place string")
    rows = df.select("place", last_comma_part(F.col("place")).alias("c"),
                     F.regexp_extract("place", LAST_PART_PATTERN, 1).alias("java")).collect()
    for r in rows:
        if r.place is None:
            assert r.c is None
            continue
        m = py_pat.search(r.place)
        assert r.c == (m.group(1) if m else r.place), repr(r.place)
