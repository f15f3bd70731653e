"""Registry of the corpus queries and of their SQL."""

from __future__ import annotations

from orecart.llm import convrepair, mixing
from orecart.llm.alignment import op13_token_alignment
from orecart.llm.bpe import op2_byte_bpe
from orecart.llm.fingerprint import op11_document_fingerprints
from orecart.llm.langid import op8_language_id
from orecart.llm.linededup import op10_line_dedup
from orecart.llm.media import op7_media_columns
from orecart.llm.quality import op4_quality
from orecart.llm.simhash import op6_simhash
from orecart.llm.substrings import op9_suffix_dedup
from orecart.llm.tokencount import op5_token_counts
from orecart.llm.topk import op1_topk_ball_tree

QUERIES = {
    "op1_topk_ball_tree": op1_topk_ball_tree,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_mixing": mixing.op3_mixing,
    "op4_quality": op4_quality,
    "op5_token_counts": op5_token_counts,
    "op6_simhash": op6_simhash,
    "op7_media_columns": op7_media_columns,
    "op8_language_id": op8_language_id,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_conversation_repair": convrepair.op12_conversation_repair,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL: dict[str, str] = {"op3_mixing": mixing.ORACLE_SQL, "op12_conversation_repair": convrepair.ORACLE_SQL}
