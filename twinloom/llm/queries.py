"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from twinloom.llm.bpe_index import op6_bpe_index
from twinloom.llm.grid_codes import OP13_SQL, op13_grid_codes
from twinloom.llm.license_diagonals import op8_license_diagonals
from twinloom.llm.minhash_forest import op1_minhash_forest
from twinloom.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from twinloom.llm.projection_passes import OP10_SQL, op10_projection_passes
from twinloom.llm.relative_lz import op4_relative_lz
from twinloom.llm.string_kernel import op9_string_kernel
from twinloom.llm.suffix_array import op5_suffix_array
from twinloom.llm.topk_tiles import OP3_SQL, op3_topk_tiles
from twinloom.llm.toxicity_grammar import op7_toxicity_grammar
from twinloom.llm.vector_packing import op2_vector_packing
from twinloom.llm.warc_archives import OP12_SQL, op12_warc_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_forest,
        op2_vector_packing,
        op3_topk_tiles,
        op4_relative_lz,
        op5_suffix_array,
        op6_bpe_index,
        op7_toxicity_grammar,
        op8_license_diagonals,
        op9_string_kernel,
        op10_projection_passes,
        op11_prefix_trie,
        op12_warc_archives,
        op13_grid_codes,
    )
}
ORACLES: dict[str, str] = {
    "op3_topk_tiles": OP3_SQL,
    "op10_projection_passes": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_warc_archives": OP12_SQL,
    "op13_grid_codes": OP13_SQL,
}
