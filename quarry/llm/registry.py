"""The dealt queries and, where SQL can express them, their DuckDB oracles."""
from __future__ import annotations

from quarry.llm.bpe import op6_bpe
from quarry.llm.chat import OP2_SQL, op2_chat_format
from quarry.llm.collocations import OP12_SQL, op12_collocations
from quarry.llm.common import prepared
from quarry.llm.decontaminate import op4_decontaminate
from quarry.llm.lexical import OP13_SQL, op13_lexical
from quarry.llm.licenses import op5_licenses
from quarry.llm.minhash import op9_near_duplicates
from quarry.llm.mixing import op11_mixing
from quarry.llm.ngram_lm import op7_lm_score
from quarry.llm.quality import op10_quality
from quarry.llm.toxicity import op8_toxicity
from quarry.llm.voronoi import OP3_SQL, op3_voronoi
from quarry.llm.warc import op1_warc

# op1 keeps the session's batch sizes
Q = {"op1_warc": op1_warc} | {f.__name__: prepared(f) for f in (op2_chat_format, op3_voronoi, op4_decontaminate, op5_licenses, op6_bpe, op7_lm_score, op8_toxicity,
                              op9_near_duplicates, op10_quality, op11_mixing, op12_collocations, op13_lexical)}

SQL: dict[str, str] = {"op2_chat_format": OP2_SQL, "op3_voronoi": OP3_SQL, "op12_collocations": OP12_SQL, "op13_lexical": OP13_SQL}
