"""The queries of the ten operators, and the same in SQL where SQL can say it."""

from millrace.llm import decontaminate, license_scan, media, packing, pii, quality, simhash, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_run_length_index_dedup": suffix_dedup.op1,
    "op2_pii_information_theoretic": pii.op2,
    "op3_license_sentence_rules": license_scan.op3,
    "op4_best_fit_packing": packing.op4,
    "op5_warc_content_addressed": warc.op5,
    "op6_simhash_covering_lsh": simhash.op6,
    "op7_quality_subword_embeddings": quality.op7,
    "op8_benchmark_containment": decontaminate.op8,
    "op9_toxicity_compression_distance": toxicity.op9,
    "op10_media_signature_sniffing": media.op10,
}
ORACLES = {
    "op1_run_length_index_dedup": suffix_dedup.OP1_SQL,
    "op3_license_sentence_rules": license_scan.OP3_SQL,
    "op5_warc_content_addressed": warc.OP5_SQL,
    "op8_benchmark_containment": decontaminate.OP8_SQL,
}
