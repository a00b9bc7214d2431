"""From raw documents to packed sequences; the stages and their rules are in chatloom/llm/pipeline.py."""

from chatloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
