"""The queries of this subpackage by name, with their SQL where SQL can express them."""

from __future__ import annotations

from .ann import op5_ann_search
from .bpe import op8_bpe_transducer
from .jaccard_join import op10_jaccard_join
from .kneser_ney import op4_kneser_ney_quality
from .langid import op9_language_id
from .mixing import op7_source_mixing
from .periodic_runs import op12_periodic_runs
from .pii import op1_pii
from .recompression import op13_recompression_dedup
from .suffix_dedup import op3_suffix_dedup
from .token_store import op6_token_planes
from .whitening import op11_embedding_whitening
from .winnowing import op2_winnowing

QUERIES = {"op1_pii": op1_pii, "op2_winnowing": op2_winnowing, "op3_suffix_dedup": op3_suffix_dedup, "op4_kneser_ney_quality": op4_kneser_ney_quality, "op5_ann_search": op5_ann_search, "op6_token_planes": op6_token_planes, "op7_source_mixing": op7_source_mixing, "op8_bpe_transducer": op8_bpe_transducer, "op9_language_id": op9_language_id, "op10_jaccard_join": op10_jaccard_join, "op11_embedding_whitening": op11_embedding_whitening, "op12_periodic_runs": op12_periodic_runs, "op13_recompression_dedup": op13_recompression_dedup}
ORACLES: dict[str, str] = {}
