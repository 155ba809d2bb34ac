"""Registered queries of this subpackage, and the SQL for those that SQL can say."""

from __future__ import annotations

from .htmlextract import op9_main_text
from .linededup import OP3_SQL, op3_line_dedup
from .media import op10_media_columns
from .mixing import OP1_SQL, op1_mix_sources
from .neardup import op8_near_duplicates
from .packing import op7_pack_sequences
from .quality import op2_quality_rules
from .tokenbin import op4_token_ids
from .tokencount import op6_token_counts
from .urlfilter import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_ids": op4_token_ids,
    "op5_url_filter": op5_url_filter,
    "op6_token_counts": op6_token_counts,
    "op7_pack_sequences": op7_pack_sequences,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_main_text": op9_main_text,
    "op10_media_columns": op10_media_columns,
}

ORACLES = {
    "op1_mix_sources": OP1_SQL,
    "op3_line_dedup": OP3_SQL,
    "op5_url_filter": OP5_SQL,
}
