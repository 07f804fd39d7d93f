"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import fim, lines, rules, warc
from .embed import op8_embedding_dedup
from .fim import op13_fill_in_middle
from .licenses import op7_license_scan
from .lines import op6_line_dedup
from .lm import op10_lm_scoring
from .minhash import op4_minhash_dedup
from .packing import op1_best_fit_packing
from .pieces import op3_sentencepiece
from .pivots import op12_nearest_neighbours
from .rules import op5_quality_rules
from .toxicity import op2_toxicity
from .variants import op11_spelling_variants
from .warc import op9_warc

_ALL = (op1_best_fit_packing, op2_toxicity, op3_sentencepiece, op4_minhash_dedup, op5_quality_rules, op6_line_dedup, op7_license_scan, op8_embedding_dedup, op9_warc, op10_lm_scoring, op11_spelling_variants, op12_nearest_neighbours, op13_fill_in_middle)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {"op5_quality_rules": rules.SQL, "op6_line_dedup": lines.SQL, "op9_warc": warc.SQL, "op13_fill_in_middle": fim.SQL}
