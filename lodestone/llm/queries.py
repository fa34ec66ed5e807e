"""Registry of the subpackage's queries and of their SQL."""

from __future__ import annotations

from . import bpe, exact_dedup, fingerprints, jaccard_join, mixing, pii, substring_dedup, token_scan, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_noisy_or": toxicity.op1_noisy_or,
        "op2_char_lm_ratio": url_filter.op2_char_lm_ratio,
        "op3_separator_scan": token_scan.op3_separator_scan,
        "op4_level_doubling": substring_dedup.op4_level_doubling,
        "op5_bpe_codec": bpe.op5_bpe_codec,
        "op6_golomb_exchange": exact_dedup.op6_golomb_exchange,
        "op7_canonical_digest": fingerprints.op7_canonical_digest,
        "op8_ipf_mix": mixing.op8_ipf_mix,
        "op9_surrogates": pii.op9_surrogates,
        "op10_lsh_forest": jaccard_join.op10_lsh_forest,
    }


def oracle_sql() -> dict:
    return {"op4_level_doubling": substring_dedup.OP4_SQL, "op6_golomb_exchange": exact_dedup.OP6_SQL, "op8_ipf_mix": mixing.OP8_SQL}
