"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import corpus_pipeline

from .byte_bpe import op6_byte_bpe
from .conversation_repair import SQL as SQL11
from .conversation_repair import op11_conversation_repair
from .exact_dedup import SQL as SQL9
from .exact_dedup import op9_exact_dedup
from .language_id import op8_language_id
from .minhash import op10_minhash
from .mixing import SQL as SQL7
from .mixing import op7_mixing
from .mpeg_audio import op4_mpeg_audio
from .pii import op1_pii
from .quality import op3_quality
from .sharding import SQL as SQL13
from .sharding import op13_sharding
from .source_divergence import SQL as SQL12
from .source_divergence import op12_source_divergence
from .toxicity import op2_toxicity
from .url_filter import SQL as SQL5
from .url_filter import op5_url_filter

QUERIES = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_mpeg_audio": op4_mpeg_audio,
    "op5_url_filter": op5_url_filter,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_mixing": op7_mixing,
    "op8_language_id": op8_language_id,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_minhash": op10_minhash,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_source_divergence": op12_source_divergence,
    "op13_sharding": op13_sharding,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {"op5_url_filter": SQL5, "op7_mixing": SQL7, "op9_exact_dedup": SQL9, "op11_conversation_repair": SQL11, "op12_source_divergence": SQL12, "op13_sharding": SQL13}
