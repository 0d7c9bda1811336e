"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle
from .alignment import op12_alignment
from .ball_tree import op11_ball_tree
from .byte_bpe import op3_byte_bpe
from .decontaminate import op2_decontaminate
from .fertility import op5_fertility
from .html_text import op8_html_text
from .quality_gam import op1_quality
from .secrets import op4_secrets
from .simhash import op6_simhash
from .substrings import op7_substrings
from .token_ids import op10_token_ids
from .vector_codes import op13_vector_codes
from .warc import op9_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_decontaminate": op2_decontaminate,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_secrets": op4_secrets,
    "op5_fertility": op5_fertility,
    "op6_simhash": op6_simhash,
    "op7_substrings": op7_substrings,
    "op8_html_text": op8_html_text,
    "op9_warc": op9_warc,
    "op10_token_ids": op10_token_ids,
    "op11_ball_tree": op11_ball_tree,
    "op12_alignment": op12_alignment,
    "op13_vector_codes": op13_vector_codes,
}

#: The other queries learn, tokenise, hash, link or parse in ways that SQL lacks; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": oracle.DECONTAMINATE,
    "op7_substrings": oracle.SUBSTRINGS,
    "op9_warc": oracle.WARC,
    "op11_ball_tree": oracle.BALL_TREE,
    "op13_vector_codes": oracle.VECTOR_CODES,
}
