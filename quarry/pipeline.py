"""Index a repository: scan, diff, parse what changed, reuse the rest, validate, publish."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions import ids, languages, text
from quarry.operators import changes, model, resolve, validate
from quarry.sources import listing, repository, store
from quarry.sources.shipping import ship
from quarry.sources.tables import cut
from quarry.syntax.engine import parse_files

INDEX_DIRECTORY = ".quarry"


@dataclass
class Stats:
    """Counters of one run."""

    scanned: int = 0
    parsed: int = 0
    reused: int = 0
    degraded: int = 0
    failed: int = 0
    unsupported: int = 0
    excluded: int = 0
    duration_ms: int = 0


@dataclass
class Result:
    model_version: str
    parent_version: str | None
    tables: dict[str, DataFrame]
    problems: DataFrame
    problem_count: int
    stats: Stats
    published: bool
    changes: DataFrame | None = field(default=None)

    def is_valid(self) -> bool:
        return self.problem_count == 0

    def summary(self) -> dict:
        """Version, counters and the first 20 problems."""
        first = [f"{r.entity_kind} {r.entity_id}: {r.rule}" for r in self.problems.orderBy("entity_kind", "entity_id", "rule").limit(20).collect()] if self.problem_count else []
        return {"model_version": self.model_version, "parent_version": self.parent_version, "published": self.published, "problems": first, **asdict(self.stats)}


def index_repository(spark: SparkSession, root: str, index_dir: str | None = None, persist: bool = True, options: repository.ScanOptions = repository.ScanOptions()) -> Result:
    """Build the model of the files below ``root`` and publish it if nothing is wrong with it.

    A file whose path and hash are those of the active version keeps its entities under the new version;
    all others are parsed.  Running again over an unchanged repository parses nothing and yields the
    same version.
    """
    began = time.time()
    ship(spark)
    home = store.Store(index_dir or f"{root.rstrip('/')}/{INDEX_DIRECTORY}")
    # contents are read, measured and dropped; those of files to parse are read again
    scanned = cut(repository.measure(repository.classify(repository.read_files(spark, root, options), options)))
    records = repository.file_records(scanned)
    version = ids.version_id(records.where("content_hash <> ''")).first()["model_version"]
    stamp = F.lit(version)
    before = home.active()
    old = {t: home.read(spark, t) for t in store.SCHEMAS} if before else {}
    usable = bool(old) and all(df is not None for df in old.values())
    empty = spark.createDataFrame([], store.SCHEMAS["files"])
    previous = old["files"] if usable else empty
    delta = cut(changes.diff(previous.select("path", "content_hash"), records.select("path", "content_hash")))
    plan = cut(changes.reuse_plan(delta, records, previous))

    code = plan.where("decision = 'PARSE'").select("path").join(scanned.where("decision = 'KEPT'").where(languages.is_code(F.col("language"))).select("path", "length", "language", "content_hash"), "path")
    read = listing.with_content(code, root)
    same = ids.content_hash("content") == F.col("content_hash")  # else the run fails, and the version before stays active
    read = read.withColumn("content", F.when(same, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("changed while it was indexed: "), "path")).cast("binary")))
    parsed = cut(parse_files(read, slices=True, balanced=True))
    outcome = parsed.select("path", F.col("parse_status").alias("s"), F.col("parse_error").alias("e"), F.col("node_count").alias("n"), F.col("max_depth").alias("d"))
    carried = plan.select("path", "decision", F.col("parse_status").alias("ps"), F.col("parse_error").alias("pe"), F.col("node_count").alias("pn"), F.col("max_depth").alias("pd"))
    files = (
        records.drop("parse_status", "parse_error", "node_count", "max_depth", "model_version")
        .join(carried, "path")
        .join(outcome, "path", "left")
        .withColumns({"parse_status": F.coalesce("s", "ps"), "parse_error": F.when(F.col("s").isNull(), F.col("pe")).otherwise(F.col("e")), "node_count": F.coalesce("n", "pn"), "max_depth": F.coalesce("d", "pd"), "model_version": stamp})
    )
    files = cut(files.drop("s", "e", "n", "d", "ps", "pe", "pn", "pd"))
    symbols = cut(model.symbol_table(parsed, files.select("path", "id", "language"), stamp))
    calls, imports, bindings = resolve.call_facts(parsed)
    tables = {
        "files": files,
        "symbols": symbols,
        "relationships": model.relationship_table(parsed, symbols, stamp),
        "evidence": model.evidence_table(symbols),
        "chunks": model.chunk_table(parsed, symbols, stamp),
        "diagnostics": model.diagnostic_table(parsed, symbols),
        "excluded": repository.exclusion_ledger(scanned),
        "calls": calls, "imports": imports, "bindings": bindings, "manifest": store.manifest(files),
    }
    names = {t: store.column_names(t) for t in store.SCHEMAS}
    tables = {t: df.select(*names[t]) for t, df in tables.items()}
    if usable:
        kept = plan.where("decision = 'REUSE'").select("path")
        kept_files = previous.join(kept, "path", "left_semi").select(F.col("id").alias("file_id"), "path")
        kept_symbols = old["symbols"].join(kept_files.select("file_id"), "file_id", "left_semi")
        own = kept_symbols.select(F.col("id").alias("symbol_id"))
        reused = {
            "symbols": kept_symbols,
            "relationships": old["relationships"].join(own.withColumnRenamed("symbol_id", "source_symbol_id"), "source_symbol_id", "left_semi"),
            "evidence": old["evidence"].join(kept_files.select("file_id"), "file_id", "left_semi"),
            "chunks": old["chunks"].join(own, "symbol_id", "left_semi"),
        }
        for t, df in reused.items():
            tables[t] = tables[t].unionByName(changes.restamp(df, stamp).select(*names[t]))
        kept_said = old["diagnostics"].join(kept.withColumnRenamed("path", "file_path"), "file_path", "left_semi")
        tables["diagnostics"] = tables["diagnostics"].unionByName(kept_said.select(*names["diagnostics"]))
        for t in ("calls", "imports", "bindings"):
            tables[t] = tables[t].unionByName(old[t].join(kept, "path", "left_semi").select(*names[t]))
    tables = {t: cut(df) for t, df in tables.items()}
    placed = tables["symbols"].join(tables["files"].select(F.col("id").alias("file_id"), "path"), "file_id")
    placed = placed.withColumn("parent", F.when(F.col("symbol_type") != "MODULE", F.regexp_extract("qualified_name", r"^(.*)[.:][^.:]*$", 1)))
    wanted = tables["calls"]
    if usable:
        gone = previous.join(kept, "path", "left_anti").select(F.col("id").alias("file_id"))
        touched = symbols.select("id", "name").unionByName(old["symbols"].join(gone, "file_id", "left_semi").select("id", "name"))
        again = cut(resolve.calls_to_resolve(wanted, tables["bindings"], old["resolutions"], parsed, touched))
        wanted = wanted.join(again, "call_id", "left_semi")
    resolved = resolve.resolve_calls(wanted, placed, tables["imports"], tables["bindings"])
    resolved = resolved.join(tables["calls"].select("call_id", "path"), "call_id").select(*names["resolutions"])
    if usable:
        known = old["resolutions"].join(again, "call_id", "left_anti").join(tables["calls"].select("call_id"), "call_id", "left_semi")
        resolved = resolved.unionByName(known.select(*names["resolutions"]))
    tables["resolutions"] = cut(resolved)
    problems = cut(validate.model_problems(*(tables[t] for t in ("files", "symbols", "relationships", "evidence", "chunks"))))
    n = problems.count()
    published = persist and n == 0
    if published and version != before:
        home.write(version, tables)
        home.publish(version, datetime.now(timezone.utc).isoformat(timespec="seconds"))
    one = tables["files"].agg(F.count("*").alias("scanned"), F.count_if(F.col("parse_status").isin("PARTIAL", "FAILED")).alias("degraded"), F.count_if(F.col("parse_status") == "FAILED").alias("failed"), F.count_if(F.col("parse_status") == "UNSUPPORTED").alias("unsupported")).first()
    stats = Stats(one.scanned, parsed.count(), plan.where("decision = 'REUSE'").count(), one.degraded, one.failed, one.unsupported, tables["excluded"].count(), int((time.time() - began) * 1000))
    return Result(version, before if before != version else None, tables, problems, n, stats, published, delta)
