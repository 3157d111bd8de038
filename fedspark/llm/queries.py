"""The queries of this package, by name, and their SQL where DuckDB can express it."""

from __future__ import annotations

from .ann import op3_neighbours
from .chat import OP7_SQL, op7_chat
from .codes import OP12_SQL, op12_codes
from .jaccard import op4_jaccard
from .lm import op10_lm
from .packing import op6_packing
from .phrases import OP13_SQL, op13_phrases
from .pii import op2_personal_data
from .quality import op8_quality
from .secrets import op9_secrets
from .sharding import op1_sharding
from .spm_codec import op5_sentencepiece
from .warc import OP11_SQL, op11_warc

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_personal_data": op2_personal_data,
    "op3_neighbours": op3_neighbours,
    "op4_jaccard": op4_jaccard,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_packing": op6_packing,
    "op7_chat": op7_chat,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_lm": op10_lm,
    "op11_warc": op11_warc,
    "op12_codes": op12_codes,
    "op13_phrases": op13_phrases,
}
ORACLE_SQL = {"op7_chat": OP7_SQL, "op11_warc": OP11_SQL, "op12_codes": OP12_SQL, "op13_phrases": OP13_SQL}
