"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .byte_bpe import op2_byte_bpe
from .chat_format import CHAT_SQL, op4_chat_format
from .decontaminate import op6_decontamination
from .fingerprints import op9_fingerprints
from .license_scan import LICENSE_SQL, op7_license_scan
from .line_dedup import LINE_SQL, op3_line_dedup
from .ngram_join import op1_ngram_jaccard_join
from .sharding import SHARDING_SQL, op5_sharding
from .toxicity import op10_toxicity
from .warc import WARC_SQL, op8_warc

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_line_dedup": op3_line_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_sharding": op5_sharding,
    "op6_decontamination": op6_decontamination,
    "op7_license_scan": op7_license_scan,
    "op8_warc": op8_warc,
    "op9_fingerprints": op9_fingerprints,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL = {
    "op3_line_dedup": LINE_SQL,
    "op4_chat_format": CHAT_SQL,
    "op5_sharding": SHARDING_SQL,
    "op7_license_scan": LICENSE_SQL,
    "op8_warc": WARC_SQL,
}
