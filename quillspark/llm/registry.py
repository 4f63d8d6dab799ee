"""The queries of this package, by name, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from .bpe import op5
from .chat import op13
from .clustering import op12
from .html import op3
from .jaccard import op8
from .merkle import op11
from .mixing import op10
from .oracles import ORACLES
from .sharding import op1
from .substring import op4
from .topk import op6
from .toxicity import op2
from .vectors import op9
from .warc import op7

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_sharding": op1, "op2_toxicity": op2, "op3_html": op3, "op4_substring": op4, "op5_bpe": op5, "op6_topk": op6, "op7_warc": op7, "op8_jaccard": op8,
    "op9_vectors": op9, "op10_mixing": op10, "op11_merkle": op11, "op12_clustering": op12, "op13_chat": op13,
}
