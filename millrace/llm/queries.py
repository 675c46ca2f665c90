"""The training-data queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import cube_mix, decontaminate, fill_middle, filter_audit, hmm_lm, html_text, kneser_ney, line_dedup, order_minhash, secret_crf, url_filter, voronoi_knn, warc

QUERIES = {
    "op1_cube_mix": cube_mix.op1_cube_mix,
    "op2_kneser_ney": kneser_ney.op2_kneser_ney,
    "op3_secret_crf": secret_crf.op3_secret_crf,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_warc": warc.op5_warc,
    "op6_hmm_lm": hmm_lm.op6_hmm_lm,
    "op7_order_minhash": order_minhash.op7_order_minhash,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_voronoi_knn": voronoi_knn.op9_voronoi_knn,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_html_text": html_text.op12_html_text,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}
ORACLES = {
    "op5_warc": warc.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op9_voronoi_knn": voronoi_knn.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op13_fill_middle": fill_middle.ORACLE,
}
