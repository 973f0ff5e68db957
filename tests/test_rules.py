from quakes.functions.gazetteer import countries, gazetteer_rows
from quakes.functions.rules import COUNTRY_REWRITES, KEYWORDS_BY_CONTINENT, OCEAN_WORDS, keyword_rows


def test_rule_table_sizes():
    assert len(COUNTRY_REWRITES) == 27
    rows = keyword_rows()
    assert len(rows) == 279
    assert len({r[1] for r in rows}) == 279
    assert len(OCEAN_WORDS) == 35
    assert list(KEYWORDS_BY_CONTINENT) == [
        "North America", "South America", "Europe", "Africa", "Asia", "Oceania", "Antarctica",
    ]


def test_keyword_priority_is_longest_first_then_dictionary_order():
    rows = sorted(keyword_rows(), key=lambda r: r[3])
    for a, b in zip(rows, rows[1:]):
        assert len(a[1]) > len(b[1]) or (len(a[1]) == len(b[1]) and a[0] < b[0])


def test_gazetteer_codes_and_namibia():
    cs = countries()
    assert len(cs) == 249
    assert len({c["alpha2"] for c in cs}) == 249
    na = [c for c in cs if c["alpha2"] == "NA"]
    assert na and na[0]["name"] == "Namibia" and na[0]["continent"] == "Africa"
    # alpha-3 order is the tie order
    assert [c["alpha3"] for c in cs] == sorted(c["alpha3"] for c in cs)
    assert all(r[2] == r[1].lower() for r in gazetteer_rows())
