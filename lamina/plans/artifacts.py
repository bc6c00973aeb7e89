"""Files of a run: small results as JSON and CSV from the driver, rankings as parquet by Spark.

``output`` is a folder the driver writes to; where that is not a folder all executors share, the
rankings still are files of the run's tables, because Spark writes them through the same path.
"""

from __future__ import annotations

import csv
import json
import os
import shutil
from collections.abc import Iterable, Mapping
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def save_json(path: str, value: Any) -> str:
    """UTF-8, indented, under a temporary name that is then renamed. Values are plain."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)
    os.replace(path + ".tmp", path)
    return path


def environment(spark: SparkSession) -> dict[str, Any]:
    """What the session ran on: versions as the JVM and Python report them, and the settings that plans
    depend on."""
    import numpy
    import pandas
    import pyarrow

    jvm, conf = spark._jvm.java.lang.System, spark.sparkContext.getConf()
    versions = {"spark": spark.version, "java": jvm.getProperty("java.version"), "scala": spark._jvm.scala.util.Properties.versionNumberString()}
    versions |= {"python": spark.sparkContext.pythonVer} | {m.__name__: m.__version__ for m in (numpy, pandas, pyarrow)}
    settings = {k: v for k, v in conf.getAll() if k.startswith(("spark.sql.", "spark.executor.", "spark.driver.memory", "spark.master"))}
    return {"versions": versions, "system": f"{jvm.getProperty('os.name')} {jvm.getProperty('os.version')}", "started_ms": spark.sparkContext.startTime, "parallelism": spark.sparkContext.defaultParallelism, "settings": settings}


def _table(path: str, columns: list[str], rows: Iterable[Mapping[str, Any]]) -> None:
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.DictWriter(f, columns)
        out.writeheader()
        out.writerows(rows)


def _by_experiment(df: DataFrame, column: str = "experiment") -> dict[str, dict[str, Any]]:
    return {r[column]: {k: v for k, v in r.asDict().items() if k != column} for r in df.collect()}


def save_report(report: Any, output: str) -> str:
    """Folder of the run under ``output`` and a ZIP of its small files, whose path is returned.

    For the run: config, dataset_summary, environment, seconds, latency, preflight, candidate_audit and
    grouped_metrics (JSON), leaderboard (CSV). For each experiment a folder with experiment and
    metrics (JSON). What grows with the queries is written by Spark and stays outside the ZIP: per_query and
    retrieval_runs (JSON lines, one folder an experiment), passage_rankings and document_rankings."""
    root = os.path.join(output, report.run_id)
    os.makedirs(root)
    board = report.leaderboard.collect()
    small = {
        "config": asdict(report.config), "dataset_summary": report.summary, "environment": environment(report.leaderboard.sparkSession),
        "seconds": report.seconds, "latency": _by_experiment(report.latency), "preflight": report.preflight,
        "candidate_audit": [r.asDict() for r in report.audit.collect()],
    }
    if report.grouped is not None:
        small["grouped_metrics"] = _by_experiment(report.grouped, "category")
    for row in board:
        name = row["experiment"]
        document, passage = name.split("__")
        small[f"{name}/experiment"] = {"name": name, "document_method": document, "passage_method": passage}
        small[f"{name}/metrics"] = {k: v for k, v in row.asDict().items() if k != "experiment"}
    for name, value in small.items():
        save_json(f"{root}/{name}.json", value)
    _table(f"{root}/leaderboard.csv", report.leaderboard.columns, (r.asDict() for r in board))
    archive = shutil.make_archive(root, "zip", root)
    report.per_query.write.partitionBy("experiment").json(f"{root}/per_query")
    report.passages.select("experiment", "query_id", "item_id", "score", "rank").write.partitionBy("experiment").json(f"{root}/retrieval_runs")
    report.passages.write.partitionBy("experiment").parquet(f"{root}/passage_rankings")
    report.documents.write.partitionBy("document_method").parquet(f"{root}/document_rankings")
    return archive
