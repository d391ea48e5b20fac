"""A training corpus from raw documents, in stages; belongs to the subpackage quadloom.llm and needs it."""

from __future__ import annotations

from quadloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
