"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from grainmill.llm import line_dedup, maxscore, ngram_sql, secret_scan, url_rules
from grainmill.llm.bpe_codec import op10_bpe_codec
from grainmill.llm.hnsw import op3_hnsw
from grainmill.llm.language_id import op1_language_id
from grainmill.llm.ngram_join import op2_ngram_join
from grainmill.llm.packing import op8_multi_length_packing
from grainmill.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_ngram_join": op2_ngram_join,
    "op3_hnsw": op3_hnsw,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_maxscore": maxscore.op6_maxscore,
    "op7_toxicity": op7_toxicity,
    "op8_multi_length_packing": op8_multi_length_packing,
    "op9_url_rules": url_rules.op9_url_rules,
    "op10_bpe_codec": op10_bpe_codec,
}

ORACLE_SQL = {
    "op2_ngram_join": ngram_sql.SQL,
    "op4_secret_scan": secret_scan.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op6_maxscore": maxscore.SQL,
    "op9_url_rules": url_rules.SQL,
}
