"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .exact_dedup import OP2_SQL, op2_exact_dedup
from .language_id import op7_language_id
from .mixing import OP9_SQL, op9_mixing
from .packing import op1_packing
from .simhash import op6_simhash
from .substring_bytes import OP5_SQL, op5_suffix_dedup
from .substring_words import OP8_SQL, op8_substring_dedup
from .surrogates import op3_surrogates
from .token_files import op4_token_files
from .topk import OP10_SQL, op10_top_k

QUERIES = {
    "op1_packing": op1_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_surrogates": op3_surrogates,
    "op4_token_files": op4_token_files,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_simhash": op6_simhash,
    "op7_language_id": op7_language_id,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_mixing": op9_mixing,
    "op10_top_k": op10_top_k,
}

ORACLE_SQL = {
    "op2_exact_dedup": OP2_SQL,
    "op5_suffix_dedup": OP5_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op9_mixing": OP9_SQL,
    "op10_top_k": OP10_SQL,
}
