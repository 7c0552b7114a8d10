"""Registry of the training-data queries and their SQL."""

from __future__ import annotations

from .decontaminate import op3_decontamination
from .lm_scoring import op2_lm_scoring
from .mixing import op10_mixing
from .negatives import op12_negatives
from .pii import op7_pii
from .prefix_trie import op11_prefix_trie
from .quality_rules import op6_quality_rules
from .repeats import op13_repeats
from .sharding import op9_sharding
from .simhash import op4_simhash
from .toxicity import op8_toxicity
from .url_filters import op5_url_filters
from .warc import op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_decontamination": op3_decontamination,
    "op4_simhash": op4_simhash,
    "op5_url_filters": op5_url_filters,
    "op6_quality_rules": op6_quality_rules,
    "op7_pii": op7_pii,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_mixing": op10_mixing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_negatives": op12_negatives,
    "op13_repeats": op13_repeats,
}
