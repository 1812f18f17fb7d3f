"""The corpus operators' queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from gleaner.llm.bpe import op2_bpe_roundtrip
from gleaner.llm.divergence import OP11_SQL, op11_source_divergence
from gleaner.llm.exact import OP12_SQL, op12_exact_copies
from gleaner.llm.jaccard import OP5_SQL, op5_ngram_jaccard
from gleaner.llm.packing import op10_best_fit_packing
from gleaner.llm.pii import op8_pii_crf
from gleaner.llm.quality import OP9_SQL, op9_quality_rules
from gleaner.llm.repeats import op6_suffix_repeats
from gleaner.llm.runs import op13_periodic_runs
from gleaner.llm.token_files import op4_token_files
from gleaner.llm.topk import OP3_SQL, op3_maxscore_top_k
from gleaner.llm.toxicity import op1_toxicity
from gleaner.llm.warc import OP7_SQL, op7_warc_index

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_bpe_roundtrip, op3_maxscore_top_k, op4_token_files, op5_ngram_jaccard, op6_suffix_repeats, op7_warc_index, op8_pii_crf, op9_quality_rules, op10_best_fit_packing, op11_source_divergence, op12_exact_copies, op13_periodic_runs)}
SQL: dict[str, str] = {"op3_maxscore_top_k": OP3_SQL, "op5_ngram_jaccard": OP5_SQL, "op7_warc_index": OP7_SQL, "op9_quality_rules": OP9_SQL, "op11_source_divergence": OP11_SQL, "op12_exact_copies": OP12_SQL}
