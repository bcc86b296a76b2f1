"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import byte_bpe, decontaminate, html_text, kneser_ney, language, mpeg_audio, near_dedup, resample, secrets, toxicity, url_filter, vector_code, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_language": language.op3_language,
    "op4_html_text": html_text.op4_html_text,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_mpeg_audio": mpeg_audio.op6_mpeg_audio,
    "op7_warc": warc.op7_warc,
    "op8_quality": kneser_ney.op8_quality,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
    "op11_url_filter": url_filter.op11_url_filter,
    "op12_resample": resample.op12_resample,
    "op13_vector_code": vector_code.op13_vector_code,
}
ORACLE_SQL = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op7_warc": warc.OP7_SQL,
    "op9_near_dedup": near_dedup.OP9_SQL,
    "op11_url_filter": url_filter.op11_sql(),
    "op12_resample": resample.OP12_SQL,
    "op13_vector_code": vector_code.op13_sql(),
}
