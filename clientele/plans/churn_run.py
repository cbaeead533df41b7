"""End-to-end churn run (M31): the reference's ``main()`` as one Spark
application writing its outputs — leaderboard and importances as CSV, the
result and insight documents as JSON, all under ``out_dir``.

    python -m clientele.plans.churn_run <sf_dir> <out_dir>
"""
from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from ..sources import sinks
from . import churn, model_queries


def run(spark: SparkSession, sf_dir: str, out_dir: str) -> None:
    out = out_dir.rstrip("/")
    sinks.write_csv(model_queries.cv_leaderboard(spark, sf_dir), f"{out}/model_comparison")
    sinks.write_csv(model_queries.feature_importance(spark, sf_dir), f"{out}/feature_importances")
    sinks.write_json(model_queries.model_summary(spark, sf_dir), f"{out}/model_results")
    sinks.write_json(model_queries.business_insights(spark, sf_dir), f"{out}/business_insights")
    sinks.write_csv(churn.churn_rates(model_queries.labelled(spark, sf_dir)), f"{out}/churn_rates")


if __name__ == "__main__":
    from ..session import build_session
    session = build_session()
    run(session, sys.argv[1], sys.argv[2])
    session.stop()
