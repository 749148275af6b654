"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .gridorder import OP1_SQL, op1_embedding_neardup
from .jaccard import op9_jaccard_join
from .language import op5_language_id, page_language_id
from .mixing import OP2_SQL, op2_source_mix
from .packing import op7_packing
from .quality import op6_quality
from .secrets import op3_secret_scan
from .simhash import op10_document_fingerprints
from .tokencount import op4_token_counts
from .toxicity import op8_toxicity

QUERIES = {
    "op1_embedding_neardup": op1_embedding_neardup,
    "op2_source_mix": op2_source_mix,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_document_fingerprints": op10_document_fingerprints,
    "page_language_id": page_language_id,
}

SQL: dict[str, str] = {
    "op1_embedding_neardup": OP1_SQL,
    "op2_source_mix": OP2_SQL,
}
