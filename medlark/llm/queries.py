"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .katz import op2_katz_scores
from .language import op7_language_fusion
from .lattice import op4_e8_near_vectors
from .mixing import OP8_SQL, op8_curriculum_mix
from .packing import op10_concat_cut_pack
from .quality import op5_weak_quality
from .secrets import op9_markov_secrets
from .sharding import op1_ring_shards
from .simhash import op6_simhash_mih
from .weighted_sampling import op3_weighted_minhash

_ALL = (
    op1_ring_shards, op2_katz_scores, op3_weighted_minhash, op4_e8_near_vectors, op5_weak_quality,
    op6_simhash_mih, op7_language_fusion, op8_curriculum_mix, op9_markov_secrets, op10_concat_cut_pack,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {"op8_curriculum_mix": OP8_SQL}
