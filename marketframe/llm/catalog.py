"""All training-data queries; importing an operator registers its query."""

from marketframe.llm import (  # noqa: F401
    chat_format,
    exact_dedup,
    hard_negatives,
    html_extract,
    language_id,
    lexical_search,
    line_dedup,
    mixing,
    near_dedup,
    packing,
    quality,
    token_files,
    vector_search,
)
from marketframe.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
