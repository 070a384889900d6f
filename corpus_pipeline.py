"""Corpus pipeline: documents in, token ids of clean, distinct, sanitised texts out.

The stages are functions of ``stockline.llm.pipeline``; this module names them
where jobs look for them.  Each stage takes (spark, docs, sf_dir) and works on
all that its predecessor kept.
"""

from stockline.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
