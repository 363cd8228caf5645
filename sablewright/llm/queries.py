"""The queries of this package's operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sablewright.llm.bpe import op3_prefix_bpe
from sablewright.llm.decontamination import op7_latent_decontamination
from sablewright.llm.exact_substrings import op2_deep_shallow_dedup
from sablewright.llm.html import op9_tree_scored_text
from sablewright.llm.images import op5_local_descriptors
from sablewright.llm.language import op6_subword_language
from sablewright.llm.near_duplicates import op10_minhash_jaccard
from sablewright.llm.neighbours import op12_one_bit_neighbours
from sablewright.llm.pii import op1_boosted_pii
from sablewright.llm.resampling import op11_importance_resampling
from sablewright.llm.sharding import op4_flow_reshard
from sablewright.llm.sql import OP2, OP10, OP11, OP12
from sablewright.llm.toxicity import op8_ftrl_toxicity
from sablewright.llm.whitening import op13_embedding_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_boosted_pii": op1_boosted_pii,
        "op2_deep_shallow_dedup": op2_deep_shallow_dedup,
        "op3_prefix_bpe": op3_prefix_bpe,
        "op4_flow_reshard": op4_flow_reshard,
        "op5_local_descriptors": op5_local_descriptors,
        "op6_subword_language": op6_subword_language,
        "op7_latent_decontamination": op7_latent_decontamination,
        "op8_ftrl_toxicity": op8_ftrl_toxicity,
        "op9_tree_scored_text": op9_tree_scored_text,
        "op10_minhash_jaccard": op10_minhash_jaccard,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_one_bit_neighbours": op12_one_bit_neighbours,
        "op13_embedding_whitening": op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_deep_shallow_dedup": OP2, "op10_minhash_jaccard": OP10, "op11_importance_resampling": OP11, "op12_one_bit_neighbours": OP12}
