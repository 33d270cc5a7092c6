"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and SQL where it can say the same."""

from __future__ import annotations

from . import chat_format
from .ann_forest import op6_ann_forest
from .chat_format import op5_chat_format
from .decontaminate import op1_decontaminate
from .kd_shards import op3_kd_shards
from .minhash_dedup import op4_minhash_dedup
from .mixing import op9_mixing
from .quality import op2_quality
from .secret_scan import op10_secret_scan
from .substring_dedup import op8_substring_dedup
from .toxicity import op7_toxicity

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_kd_shards": op3_kd_shards,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_ann_forest": op6_ann_forest,
    "op7_toxicity": op7_toxicity,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_mixing": op9_mixing,
    "op10_secret_scan": op10_secret_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op5_chat_format": chat_format.SQL,
}
