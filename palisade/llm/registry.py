"""Queries of the operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from palisade.llm.op1_decontam import op1_decontam
from palisade.llm.op2_tokens import op2_tokens
from palisade.llm import op3_chat
from palisade.llm.op4_license import op4_license
from palisade.llm.op5_langid import op5_langid
from palisade.llm.op6_simhash import op6_simhash
from palisade.llm.op7_forest import op7_forest
from palisade.llm.op8_lm import op8_lm
from palisade.llm.op9_toxicity import op9_toxicity
from palisade.llm.op10_pieces import op10_pieces
from palisade.llm import op11_ballkmeans, op12_lines, op13_codes


def _pipeline(spark, sf_dir):
    import corpus_pipeline  # at the top of the repository, above the package

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": _pipeline,
        "op1_decontam": op1_decontam,
        "op2_tokens": op2_tokens,
        "op3_chat": op3_chat.op3_chat,
        "op4_license": op4_license,
        "op5_langid": op5_langid,
        "op6_simhash": op6_simhash,
        "op7_forest": op7_forest,
        "op8_lm": op8_lm,
        "op9_toxicity": op9_toxicity,
        "op10_pieces": op10_pieces,
        "op11_ballkmeans": op11_ballkmeans.op11_ballkmeans,
        "op12_lines": op12_lines.op12_lines,
        "op13_codes": op13_codes.op13_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat": op3_chat.ORACLE,
        "op11_ballkmeans": op11_ballkmeans.ORACLE,
        "op12_lines": op12_lines.ORACLE,
        "op13_codes": op13_codes.ORACLE,
    }
