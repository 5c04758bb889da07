"""The pipeline over ``documents``: its stages, its run and its SQL (see canopy.llm.pipeline)."""

from canopy.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
