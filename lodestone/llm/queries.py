"""The registered queries of this subpackage and the SQL that some of them have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_chat, op2_html, op3_token_store, op4_decontaminate, op5_sentencepiece, op6_simhash, op7_langid, op8_quality, op9_licences, op10_lines, op11_search, op12_toxicity, op13_middle


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat": op1_chat.op1_chat,
        "op2_html": op2_html.op2_html,
        "op3_token_store": op3_token_store.op3_token_store,
        "op4_decontaminate": op4_decontaminate.op4_decontaminate,
        "op5_sentencepiece": op5_sentencepiece.op5_sentencepiece,
        "op6_simhash": op6_simhash.op6_simhash,
        "op7_langid": op7_langid.op7_langid,
        "op8_quality_rules": op8_quality.op8_quality_rules,
        "op9_licences": op9_licences.op9_licences,
        "op10_lines": op10_lines.op10_lines,
        "op11_search": op11_search.op11_search,
        "op12_toxicity": op12_toxicity.op12_toxicity,
        "op13_middle": op13_middle.op13_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": op1_chat.ORACLE, "op11_search": op11_search.ORACLE, "op13_middle": op13_middle.ORACLE}
