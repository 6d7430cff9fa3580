"""The queries of this subpackage, over the whole tables, and SQL for those that it can express."""

from __future__ import annotations

import public_tokenizers

from . import bpe, embed_dedup, exact_dedup, jaccard_join, langid, lm, mixing, pii, substring_dedup, warc
from .workspace import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN
#: For the query only; whoever replaces private data for use brings a secret of their own.
KEY = "surrogates of the registered query"


def _of(name, operator, *args):
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name), *args)


def queries():
    return {
        "op1_lm_score": _of("documents", lm.score_texts, PIECES),
        "op2_pii_surrogates": _of("documents", pii.replace_private, KEY),
        "op3_warc_segments": _of("pages", warc.archive_pages),
        "op4_substring_dedup": _of("documents", substring_dedup.remove_repeats),
        "op5_jaccard_join": _of("documents", jaccard_join.jaccard_groups),
        "op6_bpe": _of("documents", bpe.token_digests, RANKS, PATTERN),
        "op7_exact_dedup": _of("documents", exact_dedup.exact_dedup),
        "op8_embedding_dedup": _of("embeddings", embed_dedup.similar_vectors),
        "op9_language_id": _of("documents", langid.language_id, PIECES),
        "op10_mix_sources": _of("documents", mixing.mix_sources),
    }


def oracle_sql():
    return {"op3_warc_segments": warc.SQL, "op4_substring_dedup": substring_dedup.SQL, "op5_jaccard_join": jaccard_join.SQL, "op7_exact_dedup": exact_dedup.SQL, "op10_mix_sources": mixing.SQL}
