"""The registered queries of this subpackage: one for each operator, and their SQL where it can express them."""

from millrace.llm import jaccard, langid, licenses, lm, media, mixing, packing, topk, toxicity, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_licenses": licenses.op2_licenses,
    "op3_lm_score": lm.op3_lm_score,
    "op4_media": media.op4_media,
    "op5_packing": packing.op5_packing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_warc": warc.op8_warc,
    "op9_topk": topk.op9_topk,
    "op10_language": langid.op10_language,
    "pages_language": langid.pages_language,
}
SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op2_licenses": licenses.OP2_SQL,
    "op7_jaccard": jaccard.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op9_topk": topk.OP9_SQL,
}
