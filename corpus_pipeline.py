"""The stages of the corpus pipeline; their code is in the subpackage of the operators."""

from phaseloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
