"""Queries and oracle SQL of this subpackage, the pipeline included."""

from __future__ import annotations

import corpus_pipeline
from clickfold.llm.queries import QUERIES as OPERATOR_QUERIES
from clickfold.llm.queries import shipped
from clickfold.llm.sql import SQL as OPERATOR_SQL

QUERIES = {**OPERATOR_QUERIES, "pipeline": shipped(corpus_pipeline.run)}
SQL = {**OPERATOR_SQL, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
