"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from .fingerprints import op9_fingerprints
from .hnsw import op8_nearest
from .htmltext import op2_html_text
from .huffman import op3_token_files
from .licenses import op5_licenses
from .mixing import OP1_SQL, op1_mixing
from .packing import op7_packing
from .partenum import OP6_SQL, op6_ngram_jaccard
from .toxicity import op4_toxicity
from .urls import op10_url_filter

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_html_text": op2_html_text,
    "op3_token_files": op3_token_files,
    "op4_toxicity": op4_toxicity,
    "op5_licenses": op5_licenses,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_packing": op7_packing,
    "op8_nearest": op8_nearest,
    "op9_fingerprints": op9_fingerprints,
    "op10_url_filter": op10_url_filter,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op1_mixing": OP1_SQL,
    "op6_ngram_jaccard": OP6_SQL,
}
