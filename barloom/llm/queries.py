"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from barloom.llm import bpe, exact_dedup, filter_audit, media, near_dedup, packing, periodic, pii, sharding, suffix_dedup, token_counts, toxicity, warc

QUERIES = {
    "op1_dominance_best_fit_packing": packing.op1_dominance_best_fit_packing,
    "op10_suffix_merge_dedup": suffix_dedup.op10_suffix_merge_dedup,
    "op11_bit_parallel_periodic_runs": periodic.op11_bit_parallel_periodic_runs,
    "op12_filter_interaction_audit": filter_audit.op12_filter_interaction_audit,
    "op13_bilstm_crf_pii": pii.op13_bilstm_crf_pii,
    "op2_warc_archive": warc.op2_warc_archive,
    "op3_subword_bag_toxicity": toxicity.op3_subword_bag_toxicity,
    "op4_hyperminhash_near_dedup": near_dedup.op4_hyperminhash_near_dedup,
    "op5_distinct_word_bpe": bpe.op5_distinct_word_bpe,
    "op6_signature_sniffed_media": media.op6_signature_sniffed_media,
    "op7_rendezvous_sharding": sharding.op7_rendezvous_sharding,
    "op8_streaming_exact_dedup": exact_dedup.op8_streaming_exact_dedup,
    "op9_viterbi_token_counts": token_counts.op9_viterbi_token_counts,
}
ORACLE_SQL = {
    "op10_suffix_merge_dedup": suffix_dedup.ORACLE_SQL,
    "op11_bit_parallel_periodic_runs": periodic.ORACLE_SQL,
    "op12_filter_interaction_audit": filter_audit.ORACLE_SQL,
    "op2_warc_archive": warc.ORACLE_SQL,
    "op4_hyperminhash_near_dedup": near_dedup.ORACLE_SQL,
    "op6_signature_sniffed_media": media.ORACLE_SQL,
    "op7_rendezvous_sharding": sharding.ORACLE_SQL,
    "op8_streaming_exact_dedup": exact_dedup.ORACLE_SQL,
}
