"""Queries of the training-data operators."""

from __future__ import annotations

from .bpe import op7_bpe_codec
from .codes import OP11_SQL, op11_vector_codes
from .jaccard import op6_jaccard_join
from .langid import op9_language_id
from .neighbours import op3_nearest_neighbours
from .packing import op2_packing
from .phrases import OP13_SQL, op13_collocations
from .pii import op12_personal_data
from .quality import op8_quality
from .sharding import op1_sharding
from .topk import OP4_SQL, op4_top_inner_products
from .unigram import op5_token_counts
from .warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_packing": op2_packing,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_top_inner_products": op4_top_inner_products,
    "op5_token_counts": op5_token_counts,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_quality": op8_quality,
    "op9_language_id": op9_language_id,
    "op10_warc": op10_warc,
    "op11_vector_codes": op11_vector_codes,
    "op12_personal_data": op12_personal_data,
    "op13_collocations": op13_collocations,
}

#: Operators that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {"op4_top_inner_products": OP4_SQL, "op10_warc": OP10_SQL, "op11_vector_codes": OP11_SQL, "op13_collocations": OP13_SQL}
