"""Queries of the text operators and their SQL."""

from __future__ import annotations

from .bagminhash import op7_near_dedup
from .bpe_stream import op11_bpe_stream
from .chat import OP8_SQL, op8_chat_format
from .chunk_dedup import op10_substring_dedup
from .divergence import OP12_SQL, op12_source_divergence
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .exponion import OP13_SQL, op13_centroid_clusters
from .mixing import OP3_SQL, op3_mixing
from .outliers import op6_quality_rules
from .packing import op2_packing
from .quality_lm import op5_quality_classifier
from .secrets_scan import op9_secrets
from .token_output import op1_token_output

QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_packing": op2_packing,
    "op3_mixing": op3_mixing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_quality_rules": op6_quality_rules,
    "op7_near_dedup": op7_near_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_secrets": op9_secrets,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_bpe_stream": op11_bpe_stream,
    "op12_source_divergence": op12_source_divergence,
    "op13_centroid_clusters": op13_centroid_clusters,
}

SQL: dict[str, str] = {
    "op3_mixing": OP3_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op8_chat_format": OP8_SQL,
    "op12_source_divergence": OP12_SQL,
    "op13_centroid_clusters": OP13_SQL,
}
