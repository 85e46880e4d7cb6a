"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from . import contamination, html, jaccard, mixing, pii, substrings, topk, toxicity, urls, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_personal_data": pii.op2_personal_data,
    "op3_warc": warc.op3_warc,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_url_filter": urls.op5_url_filter,
    "op6_decontaminate": contamination.op6_decontaminate,
    "op7_main_text": html.op7_main_text,
    "op8_substrings": substrings.op8_substrings,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_topk": topk.op10_topk,
}

SQL = {"op1_mix_sources": mixing.OP1_SQL, "op3_warc": warc.OP3_SQL, "op5_url_filter": urls.OP5_SQL, "op8_substrings": substrings.OP8_SQL, "op10_topk": topk.OP10_SQL}
