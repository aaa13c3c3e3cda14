"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from korvane.llm.leaks import op7_leaks
from korvane.llm.licenses import op10_licenses
from korvane.llm.manifest import OP11_SQL, op11_merkle_manifest
from korvane.llm.near_dups import op4_near_dups
from korvane.llm.pieces import op5_sentencepiece
from korvane.llm.prefixes import OP13_SQL, op13_prefix_trie
from korvane.llm.quality import op8_quality
from korvane.llm.repeats import op6_suffix_dedup
from korvane.llm.sharding import op9_sharding
from korvane.llm.token_counts import op3_token_counts
from korvane.llm.topk import OP1_SQL, op1_topk
from korvane.llm.toxicity import op2_toxicity
from korvane.llm.urls import OP12_SQL, op12_url_filters

QUERIES = {
    "op1_topk": op1_topk,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_near_dups": op4_near_dups,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_leaks": op7_leaks,
    "op8_quality": op8_quality,
    "op9_sharding": op9_sharding,
    "op10_licenses": op10_licenses,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_url_filters": op12_url_filters,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk": OP1_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_url_filters": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
