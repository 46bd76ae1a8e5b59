"""The corpus operators' queries and their SQL, by name."""

from __future__ import annotations

import corpus_pipeline

from .ann import op5_ann
from .decontaminate import op7_decontaminate
from .edit_counts import op6_token_counts
from .importance import OP12_SQL, op12_importance
from .licenses import OP8_SQL, op8_license_scan
from .line_dedup import OP9_SQL, op9_line_dedup
from .mixing import OP4_SQL, op4_mixing
from .quality import op10_quality
from .quality_rules import OP13_SQL, op13_quality_rules
from .simhash import op2_simhash
from .token_output import op1_token_output
from .toxicity import op3_toxicity
from .whitening import op11_whitening

QUERIES = {q.__name__: q for q in (op1_token_output, op2_simhash, op3_toxicity, op4_mixing, op5_ann, op6_token_counts, op7_decontaminate, op8_license_scan, op9_line_dedup, op10_quality, op11_whitening, op12_importance, op13_quality_rules)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES: dict[str, str] = {"op4_mixing": OP4_SQL, "op8_license_scan": OP8_SQL, "op9_line_dedup": OP9_SQL, "op12_importance": OP12_SQL, "op13_quality_rules": OP13_SQL}
