"""The corpus queries and their SQL."""

from __future__ import annotations

from .chat_repair import op6_repair_chats
from .decontamination import op2_decontaminate
from .license_scan import op10_license_scan
from .line_dedup import OP8_SQL, op8_line_dedup
from .mixing import OP3_SQL, op3_mix_sources
from .quality_rules import OP4_SQL, op4_quality_rules
from .near_dedup import op9_near_duplicates
from .perplexity import op7_quality_classifier
from .suffix_dedup import op1_suffix_dedup
from .toxicity import op5_toxicity


def queries() -> dict:
    found = [op1_suffix_dedup, op2_decontaminate, op3_mix_sources, op4_quality_rules, op5_toxicity, op6_repair_chats, op7_quality_classifier, op8_line_dedup, op9_near_duplicates, op10_license_scan]
    return {f.__name__: f for f in found} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": OP3_SQL, "op4_quality_rules": OP4_SQL, "op8_line_dedup": OP8_SQL}


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
