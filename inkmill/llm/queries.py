"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from inkmill.llm import chat, jaccard, langid, media, packing, quality, sentencepieces, sharding, toxicity, urls


def queries():
    return {
        "op1_sentencepiece": sentencepieces.op1_sentencepiece,
        "op2_sharding": sharding.op2_sharding,
        "op3_packing": packing.op3_packing,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_chat_formatting": chat.op5_chat_formatting,
        "op6_ngram_jaccard_join": jaccard.op6_ngram_jaccard_join,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_media_columns": media.op8_media_columns,
        "op9_language_id": langid.op9_language_id,
        "op10_url_filters": urls.op10_url_filters,
    }


def oracle_sql():
    return {
        "op2_sharding": sharding.OP2_SQL,
        "op4_quality_rules": quality.OP4_SQL,
        "op5_chat_formatting": chat.OP5_SQL,
        "op6_ngram_jaccard_join": jaccard.OP6_SQL,
        "op10_url_filters": urls.OP10_SQL,
    }
