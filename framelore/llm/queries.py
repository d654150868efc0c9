"""The registered queries of this folder and their oracle SQL."""
from framelore.llm import bpe, chat, exactdup, hilbert, langid, lexical, licenses, lshforest, nndescent, packing, quality, simhash, whitening

QUERIES = {
    "op1_bpe_round_trip": bpe.op1_bpe_round_trip,
    "op2_chat_format": chat.op2_chat_format,
    "op3_language_id": langid.op3_language_id,
    "op4_quality": quality.op4_quality,
    "op5_exact_dedup": exactdup.op5_exact_dedup,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_pack_best_fit": packing.op7_pack_best_fit,
    "op8_hilbert_shards": hilbert.op8_hilbert_shards,
    "op9_minhash_lsh_forest": lshforest.op9_minhash_lsh_forest,
    "op10_nn_descent": nndescent.op10_nn_descent,
    "op11_simhash_pigeonhole": simhash.op11_simhash_pigeonhole,
    "op12_lexical_strata": lexical.op12_lexical_strata,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}
ORACLES: dict[str, str] = {
    "op5_exact_dedup": exactdup.OP5_SQL,
    "op6_license_scan": licenses.OP6_SQL,
    "op12_lexical_strata": lexical.OP12_SQL,
}
