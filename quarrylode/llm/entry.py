"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from quarrylode.llm.alignment import op13_alignment
from quarrylode.llm.ann import op10_nearest
from quarrylode.llm.decontamination import op5_decontamination
from quarrylode.llm.html_text import op1_html_text
from quarrylode.llm.lm_score import op3_lm_score
from quarrylode.llm.mixing import op9_mixing
from quarrylode.llm.periodic import op11_periodic
from quarrylode.llm.pii import op7_pii
from quarrylode.llm.sharding import op8_sharding
from quarrylode.llm.simhash import op2_simhash
from quarrylode.llm.suffixes import op12_suffixes
from quarrylode.llm.toxicity import op6_toxicity
from quarrylode.llm.url_filter import op4_url_filter
from quarrylode.llm.url_filter_sql import op4_sql

QUERIES = {f.__name__: f for f in (op1_html_text, op2_simhash, op3_lm_score, op4_url_filter, op5_decontamination, op6_toxicity, op7_pii, op8_sharding, op9_mixing, op10_nearest, op11_periodic, op12_suffixes, op13_alignment)}
ORACLES: dict[str, str] = {"op4_url_filter": op4_sql()}
