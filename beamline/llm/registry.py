"""Queries of the training-data operators and the SQL of those that SQL expresses."""

from __future__ import annotations

import corpus_pipeline

from . import alignment, chat, contamination, embeddings, importance, language, mixing, pii, quality, simhash, suffixes, tokens, urls


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_embeddings": embeddings.op2_embeddings,
        "op3_suffixes": suffixes.op3_suffixes,
        "op4_language_id": language.op4_language_id,
        "op5_url_filter": urls.op5_url_filter,
        "op6_decontamination": contamination.op6_decontamination,
        "op7_mixing": mixing.op7_mixing,
        "op8_tokens": tokens.op8_tokens,
        "op9_pii": pii.op9_pii,
        "op10_quality": quality.op10_quality,
        "op11_alignment": alignment.op11_alignment,
        "op12_resampling": importance.op12_resampling,
        "op13_chat": chat.op13_chat,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {"op2_embeddings": embeddings.OP2_SQL, "op5_url_filter": urls.OP5_SQL, "op6_decontamination": contamination.OP6_SQL, "op7_mixing": mixing.OP7_SQL, "op12_resampling": importance.OP12_SQL, "op13_chat": chat.OP13_SQL}
