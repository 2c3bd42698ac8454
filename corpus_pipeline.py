"""The corpus pipeline: quality, near duplicates, decontamination, mixing, sharding. Its stages are in gristmill.llm.pipeline."""

from gristmill.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
