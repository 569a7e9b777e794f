"""The queries of this folder, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from .common import ship


def tokenizer(name: str) -> str:
    """The installed public vocabulary file of that name; every executor has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shipped(query: Callable) -> Callable:
    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable]:
    from . import editprint, jaccard, language, lexical, mixing, neighbours, packing, secrets, simhash, suffixes, tokens, toxicity, trie

    own = {"op1_language_spans": language.op1, "op4_toxicity": toxicity.op4, "op2_multiprobe_neighbours": neighbours.op2, "op3_simhash_near_dedup": simhash.op3, "op5_token_counts": tokens.op5, "op6_weighted_mixture": mixing.op6, "op7_best_fit_packing": packing.op7, "op8_edit_fingerprints": editprint.op8, "op9_repeated_passages": suffixes.op9, "op10_secret_scan": secrets.op10, "op11_jaccard_join": jaccard.op11, "op12_conversation_trie": trie.op12, "op13_lexical_ranking": lexical.op13}
    return {name: shipped(query) for name, query in own.items()}


def oracle_sql() -> dict[str, str]:
    from . import jaccard, lexical, mixing, trie

    return {"op6_weighted_mixture": mixing.oracle(), "op11_jaccard_join": jaccard.oracle(), "op12_conversation_trie": trie.oracle(), "op13_lexical_ranking": lexical.oracle()}
