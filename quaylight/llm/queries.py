"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontaminate import op6_decontamination
from .jaccard import OP8_SQL, op8_jaccard
from .katz import op5_katz
from .language import op2_language
from .packing import op4_packing
from .repeats import op7_repeats
from .secrets import OP1_SQL, op1_secrets
from .sharding import op9_sharding
from .topk import OP10_SQL, op10_topk
from .toxicity import op3_toxicity
from .trie import OP11_SQL, op11_prefix_trie
from .warc import OP12_SQL, op12_warc
from .whiten import op13_whitening

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_language": op2_language,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_katz": op5_katz,
    "op6_decontamination": op6_decontamination,
    "op7_repeats": op7_repeats,
    "op8_jaccard": op8_jaccard,
    "op9_sharding": op9_sharding,
    "op10_topk": op10_topk,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_warc": op12_warc,
    "op13_whitening": op13_whitening,
}
SQL = {"op1_secrets": OP1_SQL, "op8_jaccard": OP8_SQL, "op10_topk": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_warc": OP12_SQL}
