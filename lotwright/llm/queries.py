"""Queries of this subpackage's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP8_REPLIES_SQL, OP8_SQL, op8_chat_formatting, op8_reply_pairs
from .conversation_trie import OP13_SQL, op13_conversation_trie
from .decontaminate import OP2_SQL, op2_decontamination
from .embeddings import op10_embedding_near_dedup
from .html_content import op5_html_extraction
from .language_id import op1_language_id
from .lexical import OP12_SQL, op12_lexical_search
from .minhash import op7_minhash_near_dedup
from .packing import op3_best_fit_packing
from .quality import op9_quality
from .token_files import op4_token_files
from .url_filter import op6_url_filter
from .window_packing import op11_window_packing

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": op1_language_id,
        "op2_decontamination": op2_decontamination,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_token_files": op4_token_files,
        "op5_html_extraction": op5_html_extraction,
        "op6_url_filter": op6_url_filter,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_chat_formatting": op8_chat_formatting,
        "op8_reply_pairs": op8_reply_pairs,
        "op9_quality": op9_quality,
        "op10_embedding_near_dedup": op10_embedding_near_dedup,
        "op11_window_packing": op11_window_packing,
        "op12_lexical_search": op12_lexical_search,
        "op13_conversation_trie": op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op8_chat_formatting": OP8_SQL, "op8_reply_pairs": OP8_REPLIES_SQL, "op12_lexical_search": OP12_SQL, "op13_conversation_trie": OP13_SQL}
