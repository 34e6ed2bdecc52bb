"""All queries of this subpackage with their oracle SQL, where SQL can say the same."""

from __future__ import annotations

from .ann import op6_ann
from .hmm_scoring import op5_hmm_scoring
from .jaccard_join import op3_jaccard_join
from .language_id import op10_language_id, op10_language_id_pages
from .mixing import op2_mixing
from .packing import op8_packing
from .quality_classifier import op9_quality_classifier
from .quality_rules import op4_quality_rules
from .spelling import op11_spelling
from .token_counts import op13_token_counts
from .url_filters import OP7_SQL, op7_url_filters
from .warc import OP1_SQL, op1_warc
from .whitening import op12_whitening

QUERIES = {
    "op1_warc": op1_warc,
    "op2_mixing": op2_mixing,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality_rules": op4_quality_rules,
    "op5_hmm_scoring": op5_hmm_scoring,
    "op6_ann": op6_ann,
    "op7_url_filters": op7_url_filters,
    "op8_packing": op8_packing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_language_id": op10_language_id,
    "op10_language_id_pages": op10_language_id_pages,
    "op11_spelling": op11_spelling,
    "op12_whitening": op12_whitening,
    "op13_token_counts": op13_token_counts,
}
ORACLES: dict[str, str] = {"op1_warc": OP1_SQL, "op7_url_filters": OP7_SQL}
