"""Every query of this folder, and the pipeline at the top of the repository."""

import corpus_pipeline
from palimpsest.llm import queries

QUERIES = {**queries.QUERIES, "pipeline": corpus_pipeline.run}
ORACLE = {**queries.ORACLE, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
