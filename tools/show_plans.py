"""Write PLANS.md: physical plans of the main stages and representative
questions (Spark's `explain()`), so plan quality can be read without running.

    python tools/show_plans.py [/root/testdata/sf0.01]
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plan_text(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain()
    from quakes.functions.text import WHITESPACE

    raw = buf.getvalue().replace(WHITESPACE, "<whitespace set>")
    # escape control / non-ASCII whitespace inside literals (the trim set)
    raw = "".join(c if (c == "\n" or (c.isprintable() and not (c.isspace() and c != " "))) else c.encode(
        "unicode_escape").decode() for c in raw)
    text = re.sub(r"#\d+L?", "", raw)  # drop expression ids
    text = re.sub(r"\[plan_id=\d+\]", "", text)
    lines = []
    for ln in text.splitlines():
        lines.append(ln if len(ln) <= 220 else ln[:217] + "...")
    return "\n".join(lines).strip()


def main(sf_dir: str) -> None:
    from quakes.functions.rules import MEDIAN_FILL_COLUMNS
    from quakes.operators.clean import clean_unfilled, fill_alert, fill_medians
    from quakes.operators.enrich import add_classes, country_lookup, map_country
    from quakes.operators.median import value_counts_long
    from quakes.operators.pairs import slice_candidates
    from quakes.plans import catalog
    from quakes.plans.pipeline import eq_table, spread
    from quakes.session import build_session
    from quakes.sources.fixture import quake_raw
    from quakes.sources.table import materialize

    spark = build_session(app="quakes-plans")
    base = clean_unfilled(spread(quake_raw(spark, sf_dir)), rewrite=False)
    lookup = materialize(country_lookup(base.select("country")), sf_dir, "plans-lookup")
    meds = {c: 0.0 for c in MEDIAN_FILL_COLUMNS}
    final = map_country(add_classes(base.transform(fill_medians, meds).transform(fill_alert)), lookup)
    eq = eq_table(spark, sf_dir)

    sections = [
        ("ETL: country lookup (C5 + D3-D7, on distinct texts)", country_lookup(base.select("country"))),
        ("ETL: median selection, step 1 (value counts)", value_counts_long(base, MEDIAN_FILL_COLUMNS)),
        ("ETL: final projection + map back (D8)", final),
        ("Q1 strongest (top-k)", catalog.q1_strongest(eq)),
        ("Q12 loss per continent (aggregate)", catalog.q12_loss_continent(eq)),
        ("Q22 shallow and deep in one month", catalog.q22_shallow_and_deep(eq)),
        ("Q23 year-over-year growth (window on per-year counts)", catalog.q23_yoy_growth(eq)),
        ("Q30 deep-focus regions (pushdown)", catalog.q30_deep_focus(eq)),
        ("Q29 candidates (range slices, Arrow scan)", slice_candidates(eq, 50.0, 3600.0)),
    ]
    out = [
        "# PLANS",
        "",
        f"Physical plans from `explain()` (Spark {spark.version}, AQE on, before execution), over the quake view at "
        f"`{sf_dir}`. Generated by `tools/show_plans.py`; expression ids removed, long lines cut.",
        "",
    ]
    for title, df in sections:
        out += [f"## {title}", "", "```", plan_text(df), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
