"""All queries of the subpackage."""

from tideline.llm import q_alignment, q_bands, q_native, q_packing, q_pairs, q_quantise, q_suffix, q_text, q_vectors  # noqa: F401
from tideline.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
