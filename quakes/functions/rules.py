"""Rule tables for cleaning and continent assignment.

Everything below the FIXED VALUES marker must stay equal to the catalogue's
published rules for results to match: the place-name rewrites, the keyword
dictionary and the ocean word list.  They are plain data; the Spark code that
uses them lives in ``quakes.functions.text`` and ``quakes.operators.enrich``.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the catalogue's rules; do not edit)
# ---------------------------------------------------------------------------

# Anchored, case-insensitive rewrites of the extracted country text, applied
# in this order.  The replacement is literal text.
COUNTRY_REWRITES: list[tuple[str, str]] = [
    (r"(?i)^off the east coast of the north island of new zealand$", "North Island of New Zealand"),
    (r"(?i)^north of ascension island$", "Ascension Island"),
    (r"(?i)^west of macquarie island$", "Macquarie Island"),
    (r"(?i)^southeast of the loyalty islands$", "Loyalty Islands"),
    (r"(?i)^east of the south sandwich islands$", "South Sandwich Islands"),
    (r"(?i)^south of the kermadec islands$", "Kermadec Islands"),
    (r"(?i)^southeast of easter island$", "Easter Island"),
    (r"(?i)^off the west coast of the south island of new zealand$", "South Island of New Zealand"),
    (r"(?i)^2021 south sandwich islands earthquake$", "South Sandwich Islands"),
    (r"(?i)^\d+ km nne of ta$", "American Samoa Islands"),
    (r"(?i)^new zealand earthquake$", "New Zealand"),
    (r"(?i)^alaska earthquake$", "Alaska"),
    (r"(?i)^kahramanmaras earthquake sequence$", "Kahramanmaras"),
    (r"(?i)^lake almanor earthquake$", "Lake Almanor"),
    (r"(?i)^japan earthquake$", "Japan"),
    (r"(?i)^new jersey earthquake$", "New Jersey"),
    (r"(?i)^texas earthquake$", "Texas"),
    (r"(?i)^nevada earthquake$", "Nevada"),
    (r"(?i)^california earthquake$", "California"),
    (r"(?i)^2025 southern tibetan plateau earthquake$", "Southern Tibetan Plateau"),
    (r"(?i)^burma \(myanmar\) earthquake$", "Myanmar"),
    (r"(?i)^2025 drake passage earthquake$", "Drake Passage"),
    (r"(?i)^russia earthquake$", "Russia"),
    (r"(?i)^2025 southern drake passage earthquake$", "Drake Passage"),
    (r"(?i)^taiwan earthquake$", "Taiwan"),
    (r"(?i)^2025 hubbard glacier earthquake$", "Hubbard Glacier"),
    (r"(?i)^louisiana earthquake$", "Louisiana"),
]

# Keyword -> continent dictionary, grouped by continent in dictionary order.
# A lowercased country text takes the continent of the longest keyword it
# contains; equal lengths go to the keyword listed first.
KEYWORDS_BY_CONTINENT: dict[str, list[str]] = {
    "North America": [
        "alaska", "california", "nevada",
        "oregon", "washington", "montana",
        "idaho", "wyoming", "utah",
        "arizona", "colorado", "new mexico",
        "texas", "oklahoma", "kansas",
        "nebraska", "south dakota", "north dakota",
        "minnesota", "iowa", "missouri",
        "arkansas", "louisiana", "mississippi",
        "tennessee", "kentucky", "illinois",
        "indiana", "ohio", "michigan",
        "wisconsin", "florida", "alabama",
        "south carolina", "north carolina",
        "virginia", "west virginia",
        "maryland", "delaware", "new jersey",
        "new york", "connecticut", "maine",
        "massachusetts", "pennsylvania",
        "hawaii", "canada", "mexico",
        "cuba", "haiti", "dominican republic",
        "jamaica", "puerto rico", "virgin islands",
        "leeward islands", "trinidad", "barbados",
        "grenada", "dominica", "saint lucia",
        "saint kitts", "saint vincent",
        "saint eustatius", "anguilla",
        "antigua", "guadeloupe", "martinique",
        "cayman islands", "bermuda", "bahamas",
        "belize", "guatemala", "honduras",
        "el salvador", "nicaragua", "costa rica",
        "panama", "saint pierre", "greenland",
        "aleutian islands", "queen charlotte",
        "vancouver island", "united states",
        "revilla gigedo", "gulf of america",
        "ak", "ca", "nv",
        "or", "wa", "mx",
    ],
    "South America": [
        "colombia", "venezuela", "guyana",
        "suriname", "brazil", "ecuador",
        "peru", "bolivia", "chile",
        "argentina", "paraguay", "uruguay",
        "falkland islands", "south georgia",
        "galapagos", "easter island",
    ],
    "Europe": [
        "iceland", "norway", "sweden", "finland",
        "denmark", "united kingdom", "ireland",
        "portugal", "spain", "france", "netherlands",
        "belgium", "germany", "switzerland", "austria",
        "italy", "malta", "greece", "albania",
        "north macedonia", "serbia", "croatia",
        "bosnia", "montenegro", "hungary",
        "slovakia", "poland", "romania", "bulgaria",
        "ukraine", "belarus", "estonia", "latvia",
        "lithuania", "kosovo", "svalbard",
        "jan mayen", "reykjanes", "azores",
    ],
    "Africa": [
        "morocco", "algeria", "tunisia", "libya",
        "egypt", "mauritania", "chad", "sudan",
        "south sudan", "ethiopia", "eritrea",
        "djibouti", "somalia", "kenya", "uganda",
        "rwanda", "burundi",
        "democratic republic of the congo", "congo",
        "gabon", "angola", "zambia", "malawi",
        "mozambique", "zimbabwe", "botswana",
        "namibia", "south africa", "madagascar",
        "tanzania", "ghana", "nigeria", "cape verde",
        "saint helena", "ascension island", "tristan da cunha",
        "mayotte", "mauritius", "seychelles",
        "prince edward islands", "crozet islands", "kerguelen",
        "bouvet", "guinea",
    ],
    "Asia": [
        "turkey", "kahramanmaras", "syria", "lebanon",
        "israel", "jordan", "iraq", "iran",
        "saudi arabia", "yemen", "oman",
        "united arab emirates", "qatar", "kuwait",
        "cyprus", "armenia", "azerbaijan",
        "turkmenistan", "uzbekistan", "kazakhstan",
        "kyrgyzstan", "tajikistan", "afghanistan",
        "pakistan", "india", "nepal", "bhutan",
        "bangladesh", "sri lanka", "maldives",
        "myanmar", "burma", "thailand", "laos",
        "vietnam", "cambodia", "malaysia", "indonesia",
        "timor", "philippines", "philippine islands",
        "china", "taiwan", "mongolia",
        "north korea", "south korea", "japan",
        "kuril islands", "russia", "xinjiang",
        "xizang", "tibetan", "kashmir", "socotra",
        "severnaya zemlya", "georgia",
    ],
    "Oceania": [
        "australia", "new zealand", "papua new guinea",
        "solomon islands", "santa cruz islands",
        "vanuatu", "fiji", "tonga",
        "samoa", "kiribati", "micronesia",
        "palau", "guam", "mariana islands",
        "new caledonia", "wallis and futuna",
        "french polynesia", "pitcairn", "cook islands",
        "kermadec", "macquarie", "loyalty islands",
        "d'entrecasteaux", "bismarck sea", "Ta",
    ],
    "Antarctica": [
        "antarctica", "south shetland",
        "south sandwich", "balleny",
        "drake", "scotia sea",
        "west chile rise", "hubbard glacier",
    ],
}

# Any of these contained in the lowercased text -> "Ocean/Other".
OCEAN_WORDS: list[str] = [
    "ocean", "sea", "ridge", "rise", "strait", "passage", "gulf", "bay",
    "channel", "fracture zone", "arctic", "atlantic", "pacific", "bering",
    "beaufort", "labrador", "norwegian", "laptev", "davis", "lomonosov",
    "carlsberg", "chagos", "mid-", "arafura", "banda", "savu", "flores",
    "molucca", "celebes", "laccadive", "ionian", "adriatic", "aegean",
    "ligurian", "caspian",
]

OCEAN_LABEL = "Ocean/Other"
UNKNOWN_LABEL = "unknown"
ALERT_MISSING = "Data_Not_available"

# Columns that are always empty in the feed and are dropped by cleaning.
EMPTY_COLUMNS = ["magerror", "magnst", "deptherror"]

# Columns cast to double, and columns whose nulls are filled with the median.
DOUBLE_COLUMNS = ["mag", "depth_km", "nst", "dmin", "rms", "gap", "sig"]
MEDIAN_FILL_COLUMNS = ["mmi", "rms", "dmin", "gap", "nst", "cdi", "felt"]

# Depth class bounds (km) and magnitude class bounds.
SHALLOW_BELOW_KM = 70.0
INTERMEDIATE_BELOW_KM = 300.0
MAG_CLASSES = [(4.0, "Minor"), (5.0, "Light"), (6.0, "Moderate"), (7.0, "Strong")]
MAG_TOP_CLASS = "Destructive"

# Weights used by the loss / casualty estimates, per magnitude class.
CASUALTY_WEIGHTS = {"Light": 0, "Minor": 10, "Moderate": 100, "Strong": 1000, "Destructive": 10000}
LOSS_WEIGHTS = {"Light": 1000, "Minor": 5000, "Moderate": 10000, "Strong": 50000, "Destructive": 100000}
ALERT_LOSS_WEIGHTS = {"green": 1000, "yellow": 5000, "orange": 50000, "red": 100000}

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------


def keyword_rows() -> list[tuple[int, str, str, int]]:
    """(ord, keyword, continent, prio) in dictionary order.

    ``prio`` is the position in the longest-first order (ties keep dictionary
    order), so the winning keyword of a text is the match with the lowest prio.
    """
    flat = [(kw, cont) for cont, kws in KEYWORDS_BY_CONTINENT.items() for kw in kws]
    order = sorted(range(len(flat)), key=lambda i: (-len(flat[i][0]), i))
    prio = {i: rank for rank, i in enumerate(order)}
    return [(i, kw, cont, prio[i]) for i, (kw, cont) in enumerate(flat)]
