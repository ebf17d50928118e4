"""Queries over the test tables that apply the training-data operators, and SQL for those it can express."""

from twigline.llm import ann, bitpack, divergence, langid, maintext, maxscore, mixing, packing, pigeonhole, preference, sharding, simhash, tiff

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_nearest": ann.op2_nearest,
    "op3_token_files": bitpack.op3_token_files,
    "op4_language_id": langid.op4_language_id,
    "op5_media": tiff.op5_media,
    "op6_preference": preference.op6_preference,
    "op7_main_text": maintext.op7_main_text,
    "op8_simhash": simhash.op8_simhash,
    "op9_sharding": sharding.op9_sharding,
    "op10_mixing": mixing.op10_mixing,
    "op11_ranked_search": maxscore.op11_ranked_search,
    "op12_embedding_dedup": pigeonhole.op12_embedding_dedup,
    "op13_source_audit": divergence.op13_source_audit,
}
ORACLE_SQL = {
    "op6_preference": preference.ORACLE_SQL,
    "op9_sharding": sharding.ORACLE_SQL,
    "op11_ranked_search": maxscore.ORACLE_SQL,
    "op12_embedding_dedup": pigeonhole.ORACLE_SQL,
    "op13_source_audit": divergence.ORACLE_SQL,
}
