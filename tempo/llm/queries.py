"""Registered queries of the training-data operators, by name."""

from __future__ import annotations

from tempo.llm import alignment, bpe, embedding_dedup, exact_dedup, licenses, packing, sentence_spans, simhash, spelling, suffix_array, token_counts, toxicity, url_reputation
from tempo.llm.common import table


def queries():
    return {
        "op3_exact_dedup": lambda spark, sf_dir: exact_dedup.exact_dedup(table(spark, sf_dir, "documents")),
        "op1_simhash": lambda spark, sf_dir: simhash.simhash_components(table(spark, sf_dir, "documents")),
        "op8_url_reputation": lambda spark, sf_dir: url_reputation.url_verdicts(table(spark, sf_dir, "pages"), url_reputation.page_outcomes(table(spark, sf_dir, "labels"))),
        "op9_embeddings": lambda spark, sf_dir: embedding_dedup.similar_vectors(table(spark, sf_dir, "embeddings")),
        "op7_licenses": lambda spark, sf_dir: licenses.license_scan(table(spark, sf_dir, "documents")),
        "op2_toxicity": lambda spark, sf_dir: toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op4_sentence_spans": lambda spark, sf_dir: sentence_spans.span_dedup(table(spark, sf_dir, "documents")),
        "op5_bpe": lambda spark, sf_dir: bpe.encoded_digests(table(spark, sf_dir, "documents")),
        "op6_suffix_array": lambda spark, sf_dir: suffix_array.substring_digests(table(spark, sf_dir, "documents")),
        "op10_packing": lambda spark, sf_dir: packing.packed_pieces(table(spark, sf_dir, "documents")),
        "op11_spelling": lambda spark, sf_dir: spelling.spelling_variants(table(spark, sf_dir, "documents")),
        "op12_token_counts": lambda spark, sf_dir: token_counts.token_counts(table(spark, sf_dir, "documents")),
        "op13_alignment": lambda spark, sf_dir: alignment.alignment_digests(table(spark, sf_dir, "documents")),
    }


def oracle_sql():
    return {"op8_url_reputation": url_reputation.ORACLE_SQL, "op3_exact_dedup": exact_dedup.ORACLE_SQL}
