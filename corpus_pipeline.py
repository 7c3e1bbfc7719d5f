"""Corpus preparation: STAGES in order, each over the table of documents that the stage before it kept."""

from __future__ import annotations

from lumenweft.llm.stages import STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: The retrieval, the forest and the near duplicates cannot be put as SQL; tests compare with brute force.
ORACLE_SQL = None
