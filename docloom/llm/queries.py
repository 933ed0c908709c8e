"""Queries of the training-data operators, by the names under which they are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.bpe_codec import op5_bpe_codec
from docloom.llm.collocations import OP13_SQL, op13_collocations
from docloom.llm.decontaminate import op6_decontaminate
from docloom.llm.divergence import OP12_SQL, op12_source_divergence
from docloom.llm.html_extract import op4_html_extract
from docloom.llm.line_dedup import OP7_SQL, op7_line_dedup
from docloom.llm.near_dedup import op9_near_dedup
from docloom.llm.quality_mil import op10_quality_mil
from docloom.llm.quality_rules import OP1_SQL, op1_quality_rules
from docloom.llm.token_counts import op8_token_counts
from docloom.llm.toxicity import op3_toxicity
from docloom.llm.url_filter import op2_url_filter
from docloom.llm.warc_archive import OP11_SQL, op11_warc_archive


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_url_filter": op2_url_filter,
        "op3_toxicity": op3_toxicity,
        "op4_html_extract": op4_html_extract,
        "op5_bpe_codec": op5_bpe_codec,
        "op6_decontaminate": op6_decontaminate,
        "op7_line_dedup": op7_line_dedup,
        "op8_token_counts": op8_token_counts,
        "op9_near_dedup": op9_near_dedup,
        "op10_quality_mil": op10_quality_mil,
        "op11_warc_archive": op11_warc_archive,
        "op12_source_divergence": op12_source_divergence,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": OP1_SQL,
        "op7_line_dedup": OP7_SQL,
        "op11_warc_archive": OP11_SQL,
        "op12_source_divergence": OP12_SQL,
        "op13_collocations": OP13_SQL,
    }
