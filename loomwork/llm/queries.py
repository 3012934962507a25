"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from .ann import OP4_SQL, op4_hnsw
from .bpe import op6_bpe
from .chat import OP5_SQL, op5_chat
from .lines import OP1_SQL, op1_lines
from .lm import OP8_SQL, op8_lm
from .packing import op10_packing
from .quality import op7_quality
from .secrets import op2_secrets
from .simhash import op3_simhash
from .toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (op1_lines, op2_secrets, op3_simhash, op4_hnsw, op5_chat, op6_bpe, op7_quality, op8_lm, op9_toxicity, op10_packing)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLE_SQL: dict[str, str] = {"op1_lines": OP1_SQL, "op4_hnsw": OP4_SQL, "op5_chat": OP5_SQL, "op8_lm": OP8_SQL}
