"""The queries of this subpackage by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillshift.llm.decontamination import OP12_SQL, op12_decontamination
from quillshift.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from quillshift.llm.html_extract import op1_html_extract
from quillshift.llm.jaccard_join import op7_jaccard_join
from quillshift.llm.line_dedup import op2_line_dedup
from quillshift.llm.mixing import op3_mixing
from quillshift.llm.packing import op8_packing
from quillshift.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from quillshift.llm.quality import op6_quality
from quillshift.llm.token_alignment import op11_token_alignment
from quillshift.llm.token_counts import op5_token_counts
from quillshift.llm.topk_search import OP10_SQL, op10_exact_topk
from quillshift.llm.warc import OP9_SQL, op9_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extract": op1_html_extract,
        "op2_line_dedup": op2_line_dedup,
        "op3_mixing": op3_mixing,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_token_counts": op5_token_counts,
        "op6_quality": op6_quality,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_packing": op8_packing,
        "op9_warc": op9_warc,
        "op10_exact_topk": op10_exact_topk,
        "op11_token_alignment": op11_token_alignment,
        "op12_decontamination": op12_decontamination,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": OP4_SQL,
        "op9_warc": OP9_SQL,
        "op10_exact_topk": OP10_SQL,
        "op12_decontamination": OP12_SQL,
        "op13_prefix_trie": OP13_SQL,
    }
