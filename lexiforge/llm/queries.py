"""Queries of this subpackage, for registration. None of them has SQL that DuckDB could run, so tests compare them with brute force."""

from __future__ import annotations

from .bpe import op5_bpe
from .context_tree import op3_context_tree
from .language_id import op7_language_id
from .licenses import op1_license_scan
from .minhash import op10_fingerprint
from .packing import op2_packing
from .perplexity import op9_quality_classifier
from .quality_rules import op6_quality_rules
from .simhash import op4_simhash
from .toxicity import op8_toxicity

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_packing, op3_context_tree, op4_simhash, op5_bpe, op6_quality_rules, op7_language_id, op8_toxicity, op9_quality_classifier, op10_fingerprint)}
ORACLES: dict[str, str] = {}
