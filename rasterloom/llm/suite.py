"""The registered queries of these operators and the SQL that must give the same rows."""

from __future__ import annotations

from rasterloom.llm import anchors, bpe, chunks, dartminhash, gracededup, langid, licenses, mixing, quality, rans, sharding, skiplist, warc

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_near_duplicates": dartminhash.op2_near_duplicates,
    "op3_quality": quality.op3_quality,
    "op4_bpe": bpe.op4_bpe,
    "op5_language": langid.op5_language,
    "op6_licenses": licenses.op6_licenses,
    "op7_warc": warc.op7_warc,
    "op8_token_files": rans.op8_token_files,
    "op9_sharding": sharding.op9_sharding,
    "op10_fingerprints": chunks.op10_fingerprints,
    "op11_fill_in_middle": skiplist.op11_fill_in_middle,
    "op12_exact_dedup": gracededup.op12_exact_dedup,
    "op13_vector_codes": anchors.op13_vector_codes,
}

ORACLES = {
    "op1_mix": mixing.OP1_SQL,
    "op6_licenses": licenses.op6_sql(),
    "op9_sharding": sharding.op9_sql(),
    "op11_fill_in_middle": skiplist.OP11_SQL,
    "op12_exact_dedup": gracededup.OP12_SQL,
}
