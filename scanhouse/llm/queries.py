"""The registered queries of the corpus operators, and their SQL where it can express them."""

from __future__ import annotations

from scanhouse.llm import (
    chat_format,
    conversation_repair,
    embedding_dedup,
    exact_dedup,
    html_extraction,
    license_scan,
    ngram_join,
    packing,
    run_detection,
    sentencepiece_codec,
    token_counts,
    toxicity,
    warc,
)

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_sentencepiece": sentencepiece_codec.op6_sentencepiece,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_warc_revisits": warc.op9_warc_revisits,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_periodic_runs": run_detection.op11_periodic_runs,
    "op12_html_extraction": html_extraction.op12_html_extraction,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

ORACLE = {
    "op1_ngram_join": ngram_join.ORACLE,
    "op7_chat_format": chat_format.ORACLE,
    "op8_embedding_dedup": embedding_dedup.ORACLE,
    "op9_warc_revisits": warc.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op12_html_extraction": html_extraction.ORACLE,
    "op13_conversation_repair": conversation_repair.ORACLE,
}
