"""Queries of this package, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from . import oracles
from .ann import op1_inverted_multi_index
from .hard_negatives import op12_radix_hard_negatives
from .hidden_markov import op13_hidden_markov
from .importance import op11_importance_resampling
from .near_dedup import op2_probminhash_dedup
from .packing import op4_grouping_ga_packing
from .language_id import op7_kneser_ney_langid
from .line_dedup import op5_line_spread
from .mixing import op9_curriculum_mix
from .quality_model import op8_hierarchical_quality
from .quality_rules import op3_rule_ledger
from .quotations import op10_quotation_threads
from .sharding import op6_tiered_shards


def queries() -> dict:
    return {f.__name__: f for f in (op1_inverted_multi_index, op2_probminhash_dedup, op3_rule_ledger, op4_grouping_ga_packing, op5_line_spread, op6_tiered_shards, op7_kneser_ney_langid, op8_hierarchical_quality, op9_curriculum_mix, op10_quotation_threads, op11_importance_resampling, op12_radix_hard_negatives, op13_hidden_markov)}


def oracle_sql() -> dict[str, str]:
    return {"op10_quotation_threads": oracles.op10_sql(), "op5_line_spread": oracles.op5_sql(), "op3_rule_ledger": oracles.op3_sql(), "op9_curriculum_mix": oracles.op9_sql()}
