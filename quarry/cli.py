"""Command line: index, status, query, ask, inspect and export, as text or JSON."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession, functions as F

from quarry.operators.answers import answer
from quarry.operators.retrieve import context
from quarry.pipeline import INDEX_DIRECTORY, index_repository
from quarry.sources.store import SCHEMAS, Store, export_json


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quarry")
    p.add_argument("command", choices=["index", "status", "query", "inspect", "export", "ask"])
    p.add_argument("root")
    p.add_argument("name", nargs="?")
    p.add_argument("--intent", default="DEFINITION")
    p.add_argument("--limit", type=int, help="show at most so many rows; all by default")
    p.add_argument("--json", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    home = Store(f"{a.root.rstrip('/')}/{INDEX_DIRECTORY}")

    def shown(df):
        """The rows, streamed partition by partition."""
        return (df if a.limit is None else df.limit(a.limit)).toLocalIterator()

    if a.command == "index":
        out = index_repository(spark, a.root).summary()
    elif home.active() is None:
        out = {"error": "no published version"}
    elif a.command == "status":
        files = home.read(spark, "files")
        said = home.read(spark, "files").where("parse_status in ('PARTIAL', 'FAILED')").orderBy("path").select("path", "parse_status", "parse_error")
        excluded = home.read(spark, "excluded").groupBy("reason").count()
        out = {"model_version": home.active(), "degraded": [r.asDict() for r in shown(said)], "excluded": {r[0]: r[1] for r in excluded.collect()}, "statuses": {r[0]: r[1] for r in files.groupBy("parse_status").count().collect()}, "languages": {r[0]: r[1] for r in files.where("language is not null").groupBy("language").count().collect()}}
    elif a.command == "export":
        out = {}
        for name in SCHEMAS:
            out[name] = f"{a.name or a.root}/{name}.json"
            export_json(home.read(spark, name), name, out[name])
    elif a.command == "ask":
        edges = home.read(spark, "relationships").select(F.col("source_symbol_id").alias("source"), F.col("target_symbol_id").alias("target"))
        out = {"rows": [r.asDict() for r in shown(context(a.name or "", home.read(spark, "symbols"), home.read(spark, "chunks"), edges).orderBy("position"))]}
    elif a.command == "query":
        edges = home.read(spark, "relationships").select(F.col("source_symbol_id").alias("source"), F.col("target_symbol_id").alias("target"))
        out = {"rows": [r.asDict() for r in shown(answer(a.intent, a.name or "", home.read(spark, "symbols"), edges))]}
    else:
        out = {"symbols": [r.asDict(True) for r in shown(home.read(spark, "symbols").where(F.col("qualified_name").contains(a.name or "")))]}
    print(json.dumps(out, indent=2, ensure_ascii=False, default=str) if a.json else "\n".join(f"{k}: {v}" for k, v in out.items()))
    return int("error" in out)


if __name__ == "__main__":
    raise SystemExit(main())
