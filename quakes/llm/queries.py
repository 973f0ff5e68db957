"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quakes.llm.chat_windows import op4_chat_windows
from quakes.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from quakes.llm.feast_whitening import op12_feast_whitening
from quakes.llm.line_dedup import OP11_SQL, op11_line_dedup
from quakes.llm.packing import op8_best_fit_packing
from quakes.llm.page_text import op5_page_text
from quakes.llm.periodic_runs import op13_periodic_runs
from quakes.llm.piece_codec import op10_piece_codec
from quakes.llm.pitman_yor import op2_pitman_yor
from quakes.llm.quality_rules import OP7_SQL, op7_quality_rules
from quakes.llm.secret_scan import op9_secret_scan
from quakes.llm.simhash_dedup import op1_simhash_dedup
from quakes.llm.zip_archives import op6_warc_zip

QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_dedup,
        op2_pitman_yor,
        op3_exact_dedup,
        op4_chat_windows,
        op5_page_text,
        op6_warc_zip,
        op7_quality_rules,
        op8_best_fit_packing,
        op9_secret_scan,
        op10_piece_codec,
        op11_line_dedup,
        op12_feast_whitening,
        op13_periodic_runs,
    )
}

SQL = {"op3_exact_dedup": OP3_SQL, "op7_quality_rules": OP7_SQL, "op11_line_dedup": OP11_SQL}


def queries():
    import corpus_pipeline  # lies above the package, which calls it from nowhere else

    return {**QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql():
    return dict(SQL)
