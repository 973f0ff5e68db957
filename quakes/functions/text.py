"""Column expressions for the text cleaning rules."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from quakes.functions.rules import COUNTRY_REWRITES

# Whitespace as Python's str.strip() sees it: ASCII controls \t..\r, the
# information separators \x1c-\x1f, NEL, and every Unicode separator (Z*).
WS_CLASS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
STRIP_PATTERN = rf"^{WS_CLASS}+|{WS_CLASS}+$"
# The same set spelled out (derived from str.isspace), for a non-regex trim.
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())

# Last comma-separated part of a place ("12 km NE of X, Japan" -> "Japan");
# the whitespace after the comma is Python's (Unicode) whitespace.
LAST_PART_PATTERN = rf",{WS_CLASS}*([^,]+)$"


def _accent_table() -> tuple[str, str]:
    """Latin letters (U+00C0-U+024F) that decompose to one base letter plus
    combining marks -> that base letter (derived from Unicode, not listed)."""
    src, dst = [], []
    for cp in range(0xC0, 0x250):
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, UNACCENTED = _accent_table()
_FOLD = str.maketrans(ACCENTED, UNACCENTED)


def fold_accents_py(text: str) -> str:
    return text.translate(_FOLD)


def fold_accents(c: Column) -> Column:
    """Accent folding for matching (e.g. "Réunion" -> "Reunion")."""
    return F.translate(c, ACCENTED, UNACCENTED)


def strip_ws(c: Column) -> Column:
    """Trim whitespace at both ends (null stays null).

    ``trim(BOTH chars FROM c)`` with the explicit whitespace set: no regex,
    stays in codegen.
    """
    return F.trim(c, F.lit(WHITESPACE))


def last_comma_part(place: Column) -> Column:
    """C4: what ``LAST_PART_PATTERN`` (group 1) extracts, else the whole place.

    Written without a regex: the text after the last comma, leading whitespace
    removed; if that leaves nothing but the tail was all whitespace, the regex
    would give back its last character (``[^,]+`` needs one), so that is kept.
    No comma, or nothing after it: no match, the whole place.
    """
    tail = F.substring_index(place, ",", -1)
    lead_trimmed = F.ltrim(tail, F.lit(WHITESPACE))
    part = (
        F.when((F.instr(place, ",") == 0) | (tail == ""), F.lit(None))
        .when(lead_trimmed != "", lead_trimmed)
        .otherwise(F.substring(tail, -1, 1))
    )
    return F.coalesce(part, place)


def _java_pattern(p: str) -> str:
    # Python's str patterns are Unicode-aware: (?i) folds case over Unicode and
    # \d matches any decimal digit.  Java's U flag gives both.
    return p.replace("(?i)", "(?iU)", 1)


def _any_rule_pattern() -> str:
    """One alternation of all (anchored, whole-string) rule patterns."""
    bodies = []
    for p, _ in COUNTRY_REWRITES:
        body = p.replace("(?i)", "", 1)
        assert body.startswith("^") and body.endswith("$")
        bodies.append(body[1:-1])
    return "(?iU)^(?:" + "|".join(f"(?:{b})" for b in bodies) + ")$"


def apply_rewrites(country: Column) -> Column:
    """The ordered anchored rewrites, as a chain of regexp_replace.

    Every rule matches a whole string, so a text matched by no rule passes the
    chain unchanged: one combined pattern decides whether the chain runs at
    all (one regex per row instead of 27 for the usual, unmatched text).
    """
    out = country
    for pattern, repl in COUNTRY_REWRITES:
        out = F.regexp_replace(out, _java_pattern(pattern), F.lit(repl.replace("\\", "\\\\").replace("$", "\\$")))
    return F.when(country.rlike(_any_rule_pattern()), out).otherwise(country)


def country_of(place: Column) -> Column:
    """C4 + C5 on an already trimmed place."""
    return apply_rewrites(last_comma_part(place))
