"""python -m sonoplan audit EXPORT [--language en] | probe NAME=PATH... : audits an export of metadata (exit 1 on issues), or probes sources (exit 2 unless all could be inspected)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sonoplan.operators import leakage
from sonoplan.sources import metadata


def audit(spark: SparkSession, path: str, language: str) -> int:
    rows = metadata.read_rows(spark, path)
    names = ("row_id", "utterance_id", "speaker_id", "audio_sha256", "language", "split", "label", "text")
    exact = F.lower(metadata.lookup(F.col("row"), "is_text_exact")) == "true"
    found = leakage.metadata_audit(rows.select(*(metadata.lookup(F.col("row"), n).alias(n) for n in names), exact.alias("is_text_exact")), language)
    status = leakage.audit_status(found).first().asDict()
    print(json.dumps(status | {"found": [r.asDict() for r in found.orderBy("kind", "name").collect()]}, indent=2))
    return int(status["status"] != "metadata_checks_passed")


def probe(spark: SparkSession, sources: list[str]) -> int:
    cells = {(name, ""): path for name, path in (s.split("=", 1) for s in sources)}
    rows = metadata.source_probe(spark, cells).orderBy("source").collect()
    print(json.dumps([r.asDict() for r in rows], indent=2))
    return 2 * any(r["status"] != "inspected" for r in rows)


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sonoplan")
    tasks = parser.add_subparsers(dest="task", required=True)
    one = tasks.add_parser("audit")
    one.add_argument("export")
    one.add_argument("--language", default="en")
    tasks.add_parser("probe").add_argument("sources", nargs="+")
    chosen = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    return audit(spark, chosen.export, chosen.language) if chosen.task == "audit" else probe(spark, chosen.sources)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
