"""The registered queries of this subpackage: each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curbledger.llm.chat_format import OP6_SQL, op6_chat_format
from curbledger.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from curbledger.llm.fill_middle import OP13_SQL, op13_fill_middle
from curbledger.llm.hilbert_packing import op4_hilbert_packing
from curbledger.llm.language_id import op8_language_id
from curbledger.llm.merge_dropout import op5_merge_dropout
from curbledger.llm.minhash_forest import op3_minhash_forest
from curbledger.llm.page_text import op12_page_text
from curbledger.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from curbledger.llm.quality_rules import op10_quality_rules
from curbledger.llm.substring_dedup import op1_substring_dedup
from curbledger.llm.token_files import op7_token_files
from curbledger.llm.weak_labels import op9_weak_labels


def _over(operator: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": _over(op1_substring_dedup, "documents"),
    "op2_exact_dedup": _over(op2_exact_dedup, "documents"),
    "op3_minhash_forest": _over(op3_minhash_forest, "documents"),
    "op4_hilbert_packing": _over(op4_hilbert_packing, "documents"),
    "op5_merge_dropout": _over(op5_merge_dropout, "documents"),
    "op6_chat_format": _over(op6_chat_format, "conversations"),
    "op7_token_files": _over(op7_token_files, "documents"),
    "op8_language_id": _over(op8_language_id, "documents"),
    "op9_weak_labels": _over(op9_weak_labels, "documents", "labels"),
    "op10_quality_rules": _over(op10_quality_rules, "documents", "labels"),
    "op11_prefix_trie": _over(op11_prefix_trie, "conversations"),
    "op12_page_text": _over(op12_page_text, "pages"),
    "op13_fill_middle": _over(op13_fill_middle, "documents"),
}

#: The others train a model, follow a graph or write files; tests hold them against brute force.
ORACLE_SQL = {
    "op2_exact_dedup": OP2_SQL,
    "op6_chat_format": OP6_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op13_fill_middle": OP13_SQL,
}
