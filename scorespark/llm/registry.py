"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import decontaminate, fingerprint, language, packing, quality, simhash, sstable, toxicity, warc, wordpiece

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_quality_ordinal,
        toxicity.op2_toxicity_subword,
        fingerprint.op3_fingerprint_bottomk,
        decontaminate.op4_decontaminate_index,
        sstable.op5_token_sstable,
        simhash.op6_simhash_trie,
        warc.op7_warc_normalise,
        packing.op8_pack_genetic,
        wordpiece.op9_token_counts,
        language.op10_language_mixture,
    )
}

ORACLES: dict[str, str] = {
    "op4_decontaminate_index": decontaminate.ORACLE,
    "op7_warc_normalise": warc.ORACLE,
}
