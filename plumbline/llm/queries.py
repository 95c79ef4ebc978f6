"""The registered queries of this package. Vector codes have SQL; the tests hold the others against brute
force, an exact round trip or held-out accuracy."""

import corpus_pipeline
from plumbline.llm import (
    bpe, decontam, jaccard, language, lm, partcodes, quality, repeats, secrets, simhash, tokencount, toxicity, whitening,
)

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_suffix_dedup": repeats.query,
    "op3_jaccard_join": jaccard.query,
    "op4_language_id": language.query,
    "op5_lm_scoring": lm.query,
    "op6_decontamination": decontam.query,
    "op7_quality_rules": quality.query,
    "op8_bpe": bpe.query,
    "op9_secrets": secrets.query,
    "op10_token_counts": tokencount.query,
    "op11_whitening": whitening.query,
    "op12_vector_codes": partcodes.query,
    "op13_simhash": simhash.query,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {"op12_vector_codes": partcodes.oracle()}
