"""Queries of the corpus operators, and their SQL where SQL can express them."""

from tidewire.llm import centroids, fingerprint, html_text, infilling, jaccard, langid, mixing, packing, sharding, substring, suffix, topk, warc

QUERIES = {
    "op1_near_duplicates": jaccard.op1_near_duplicates,
    "op2_topk": topk.op2_topk,
    "op3_warc": warc.op3_warc,
    "op4_substring": substring.op4_substring,
    "op5_langid": langid.op5_langid,
    "op6_mixing": mixing.op6_mixing,
    "op7_packing": packing.op7_packing,
    "op8_html": html_text.op8_html,
    "op9_fingerprint": fingerprint.op9_fingerprint,
    "op10_suffix": suffix.op10_suffix,
    "op11_sharding": sharding.op11_sharding,
    "op12_centroids": centroids.op12_centroids,
    "op13_fill_in_middle": infilling.op13_fill_in_middle,
}
ORACLES = {
    "op1_near_duplicates": jaccard.ORACLE,
    "op2_topk": topk.ORACLE,
    "op3_warc": warc.ORACLE,
    "op4_substring": substring.ORACLE,
    "op10_suffix": suffix.ORACLE,
    "op11_sharding": sharding.ORACLE,
    "op12_centroids": centroids.ORACLE,
    "op13_fill_in_middle": infilling.ORACLE,
}
