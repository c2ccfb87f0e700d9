"""Queries of this subpackage, by name, and the SQL that states their results."""

from __future__ import annotations

from . import mixing, urlrules
from .alignment import op12_cross_tokenizer_alignment
from .html import op6_html_extraction
from .lines import op5_line_dedup
from .mixing import op8_mix_sources
from .packing import op4_packing
from .piecewise import op2_document_fingerprints
from .quality import op11_quality_rules
from .simhash import op10_simhash_near_dedup
from .toxicity import op1_toxicity
from .urlrules import op7_url_filters
from .vectors import op3_embedding_range_join
from .warc import op9_warc
from .whitening import op13_embedding_whitening

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_embedding_range_join": op3_embedding_range_join,
    "op4_packing": op4_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_url_filters": op7_url_filters,
    "op8_mix_sources": op8_mix_sources,
    "op9_warc": op9_warc,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_quality_rules": op11_quality_rules,
    "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
    "op13_embedding_whitening": op13_embedding_whitening,
}
SQL: dict[str, str] = {"op7_url_filters": urlrules.SQL, "op8_mix_sources": mixing.SQL}
