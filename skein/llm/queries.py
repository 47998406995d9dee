"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import bpe, crosstok, decontam, lines, lm, merkle, mixing, pii, quality, repeats, simhash, toxicity, winnow


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_quality": quality.op2_quality,
        "op3_line_dedup": lines.op3_line_dedup,
        "op4_lm": lm.op4_lm,
        "op5_fingerprints": winnow.op5_fingerprints,
        "op6_decontamination": decontam.op6_decontamination,
        "op7_repeats": repeats.op7_repeats,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_pii": pii.op9_pii,
        "op10_bpe": bpe.op10_bpe,
        "op11_merkle": merkle.op11_merkle,
        "op12_mixing": mixing.op12_mixing,
        "op13_alignment": crosstok.op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": lines.OP3_SQL, "op11_merkle": merkle.OP11_SQL, "op12_mixing": mixing.OP12_SQL}
