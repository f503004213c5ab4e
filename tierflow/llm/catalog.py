"""All queries of this subpackage, the corpus pipeline among them."""

import corpus_pipeline
from tierflow.llm.queries import CHECKS, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    CHECKS["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["CHECKS", "QUERIES"]
