"""All queries of this subpackage: importing the operators registers them."""

from ledgerloom.llm import (  # noqa: F401
    decontamination,
    jaccard_join,
    language_id,
    lattice_join,
    license_scan,
    preferences,
    prefix_trie,
    quality_classifier,
    quality_rules,
    sentencepiece_viterbi,
    suffix_dedup,
    vector_codes,
    warc,
)
from ledgerloom.llm.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
