"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from .chat import op8_chat
from .htmltext import op5_html_text
from .linededup import OP3_SQL, op3_line_dedup
from .media import op1_media_columns
from .mixing import TARGETS_SQL, mixing_targets, op9_mixing
from .multiindex import EXACT_SQL, neighbours_exact, op2_neighbours
from .quality import op10_quality
from .sentencepiece import op7_sentencepiece
from .sharding import PLACES_SQL, op4_sharding, sharding_places
from .simhash import op6_simhash

QUERIES = {
    "op1_media_columns": op1_media_columns,
    "op2_neighbours": op2_neighbours,
    "op3_line_dedup": op3_line_dedup,
    "op4_sharding": op4_sharding,
    "op5_html_text": op5_html_text,
    "op6_simhash": op6_simhash,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_chat": op8_chat,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
    "neighbours_exact": neighbours_exact,
    "sharding_places": sharding_places,
    "mixing_targets": mixing_targets,
}

ORACLE: dict[str, str] = {"neighbours_exact": EXACT_SQL, "op3_line_dedup": OP3_SQL, "sharding_places": PLACES_SQL, "mixing_targets": TARGETS_SQL}
