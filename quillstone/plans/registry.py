"""Registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quillstone.plans import calibration_queries, composer_queries, contract_queries, cue_queries, extra_queries, flow_queries, gate_queries, metric_queries, more_queries, privacy_queries, session_queries, source_queries, study_queries
from quillstone.plans.deploy import ship

Query = Callable[[SparkSession, str], DataFrame]


def _shipped(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {k: _shipped(f) for k, f in (privacy_queries.QUERIES | metric_queries.QUERIES | flow_queries.QUERIES | more_queries.QUERIES | study_queries.QUERIES | extra_queries.QUERIES | source_queries.QUERIES | session_queries.QUERIES | cue_queries.QUERIES | composer_queries.QUERIES | contract_queries.QUERIES | calibration_queries.QUERIES | gate_queries.QUERIES).items()}
ORACLE_SQL: dict[str, str] = privacy_queries.ORACLE_SQL | metric_queries.ORACLE_SQL | flow_queries.ORACLE_SQL | more_queries.ORACLE_SQL | study_queries.ORACLE_SQL | extra_queries.ORACLE_SQL | source_queries.ORACLE_SQL | session_queries.ORACLE_SQL | cue_queries.ORACLE_SQL | composer_queries.ORACLE_SQL | contract_queries.ORACLE_SQL | calibration_queries.ORACLE_SQL | gate_queries.ORACLE_SQL
FLAGSHIP = QUERIES["win01_05_leakage"]
