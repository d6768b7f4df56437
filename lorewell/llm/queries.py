"""Queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorewell.llm.conversations import OP13_SQL, op13_conversation_repair
from lorewell.llm.impact_search import OP6_SQL, op6_exact_top_k
from lorewell.llm.infilling import OP11_SQL, op11_fill_in_middle
from lorewell.llm.language import op5_language_id
from lorewell.llm.learned_partitions import op10_nearest_neighbours
from lorewell.llm.licenses import OP12_SQL, op12_license_scan
from lorewell.llm.mixing import op9_mix_sources
from lorewell.llm.packing import op1_best_fit_packing
from lorewell.llm.secrets import op2_secret_scan
from lorewell.llm.simhash import op4_simhash_near_dedup
from lorewell.llm.token_counts import op8_token_counts
from lorewell.llm.token_files import op3_token_files
from lorewell.llm.url_filter import OP7_SQL, op7_url_filter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {
    run.__name__: run
    for run in (
        op1_best_fit_packing,
        op2_secret_scan,
        op3_token_files,
        op4_simhash_near_dedup,
        op5_language_id,
        op6_exact_top_k,
        op7_url_filter,
        op8_token_counts,
        op9_mix_sources,
        op10_nearest_neighbours,
        op11_fill_in_middle,
        op12_license_scan,
        op13_conversation_repair,
    )
}
ORACLES: dict[str, str] = {
    "op6_exact_top_k": OP6_SQL,
    "op7_url_filter": OP7_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_license_scan": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
