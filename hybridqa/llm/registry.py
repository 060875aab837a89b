"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from hybridqa.llm.decontaminate import op8_decontaminate
from hybridqa.llm.near_dedup import op3_near_dedup
from hybridqa.llm.packing import op6_packing
from hybridqa.llm.pii import op2_pii
from hybridqa.llm.quality import op10_quality_rules
from hybridqa.llm.substring_dedup import op7_substring_dedup
from hybridqa.llm.suffix_dedup import op4_suffix_dedup
from hybridqa.llm.token_counts import op1_token_counts
from hybridqa.llm.toxicity import op5_toxicity
from hybridqa.llm.url_filter import op9_url_filter
from hybridqa.llm.url_filter import oracle_sql as url_filter_sql

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_pii, op3_near_dedup, op4_suffix_dedup, op5_toxicity, op6_packing, op7_substring_dedup, op8_decontaminate, op9_url_filter, op10_quality_rules)}
ORACLES: dict[str, str] = {"op9_url_filter": url_filter_sql()}
