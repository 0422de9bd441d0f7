"""Queries of the training-data operators and the DuckDB statements that match them."""

from __future__ import annotations

from quire.llm.centroids import OP13_SQL, op13_centroid_clusters
from quire.llm.chat import op1_chat_format
from quire.llm.fingerprints import op5_fingerprints
from quire.llm.language import op7_language_id
from quire.llm.licenses import OP8_SQL, op8_license_scan
from quire.llm.line_dedup import OP9_SQL, op9_line_dedup
from quire.llm.mixing import OP10_SQL, op10_mix_sources
from quire.llm.near_duplicates import op3_near_duplicates
from quire.llm.packing import op4_packing
from quire.llm.quality import OP2_SQL, op2_quality_rules
from quire.llm.search import OP11_SQL, op11_lexical_search
from quire.llm.url_filter import OP6_SQL, op6_url_filter
from quire.llm.warc import OP12_SQL, op12_warc_archives

QUERIES = {f.__name__: f for f in (op1_chat_format, op2_quality_rules, op3_near_duplicates, op4_packing, op5_fingerprints, op6_url_filter, op7_language_id, op8_license_scan, op9_line_dedup, op10_mix_sources, op11_lexical_search, op12_warc_archives, op13_centroid_clusters)}
ORACLE_SQL = {
    "op2_quality_rules": OP2_SQL,
    "op6_url_filter": OP6_SQL,
    "op8_license_scan": OP8_SQL,
    "op9_line_dedup": OP9_SQL,
    "op10_mix_sources": OP10_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_warc_archives": OP12_SQL,
    "op13_centroid_clusters": OP13_SQL,
}
