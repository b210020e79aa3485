"""The corpus pipeline: quality, language, near-duplicates, packing. The stages are in marketloom.llm.pipeline."""

from marketloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
