"""The queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from .bpe import op6_byte_bpe
from .chunks import op4_substring_chunks
from .clusters import OP13_SQL, op13_ptolemaic_clusters
from .codes import OP12_SQL, op12_trie_codes
from .exact import OP10_SQL, op10_exact_dedup
from .extract import op3_html_text
from .neighbours import op11_nn_descent
from .packing import op7_packing
from .pii import op5_surrogates
from .quality import op9_quality_bands
from .simhash import op2_simhash
from .toxicity import op8_toxicity
from .warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_simhash": op2_simhash,
    "op3_html_text": op3_html_text,
    "op4_substring_chunks": op4_substring_chunks,
    "op5_surrogates": op5_surrogates,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_quality_bands": op9_quality_bands,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_nn_descent": op11_nn_descent,
    "op12_trie_codes": op12_trie_codes,
    "op13_ptolemaic_clusters": op13_ptolemaic_clusters,
}
ORACLE = {"op1_warc": OP1_SQL, "op10_exact_dedup": OP10_SQL, "op12_trie_codes": OP12_SQL, "op13_ptolemaic_clusters": OP13_SQL}
