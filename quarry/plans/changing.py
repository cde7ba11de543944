"""Queries of change detection, nesting, validation and the model's counts."""

from pyspark.sql import Window as W, functions as F

from quarry.operators import changes, lookups, model, nesting, snapshot_diff, validate
from quarry.sources.tables import cut, table


def _ends(spark, folder):
    """The first and the last snapshot of each repository, as manifests of path and content_hash."""
    held = cut(snapshot_diff.resolve_entries(table(spark, folder, "manifest_entries")).where("ordinal = 1 or next_no is null").select(F.concat_ws("/", "repo", "path").alias("path"), "ordinal", "next_no", "digest"))
    pick = lambda c: held.where(c).select("path", F.coalesce("digest", F.lit("")).alias("content_hash"))
    return pick("ordinal = 1"), pick("next_no is null")


def change_detect(spark, folder):
    return changes.diff(*_ends(spark, folder))


def change_stats(spark, folder):
    return changes.statistics(change_detect(spark, folder))


def scheduled_paths(spark, folder):
    return changes.scheduled_paths(change_detect(spark, folder))


def rename_pairs(spark, folder):
    old, new = _ends(spark, folder)
    return changes.rename_pairs(old.join(new.select("path"), "path", "left_anti"), new.join(old.select("path"), "path", "left_anti"))


def _scans(spark, folder):
    """The earliest and the latest scan of each file record."""
    r = table(spark, folder, "file_records").select(F.col("id").alias("path"), F.coalesce("content_hash", F.lit("")).alias("content_hash"), "parse_status", "parse_error", "node_count", "max_depth", "scanned_at").distinct()
    tie = ["content_hash", "parse_status", "parse_error", "node_count", "max_depth"]
    nth = lambda *order: r.withColumn("k", F.row_number().over(W.partitionBy("path").orderBy(*order))).where("k = 1").drop("k", "scanned_at")
    return nth(F.asc_nulls_first("scanned_at"), *(F.asc_nulls_first(t) for t in tie)), nth(F.desc_nulls_last("scanned_at"), *(F.desc_nulls_last(t) for t in tie))


def reuse_plan(spark, folder):
    first, last = _scans(spark, folder)
    delta = changes.diff(first.select("path", "content_hash"), last.select("path", "content_hash"))
    return changes.reuse_plan(delta, last, first)


def run_counters(spark, folder):
    """What a run over the latest scans has to do: files by decision and outcome."""
    plan = reuse_plan(spark, folder)
    one = lambda c: F.count_if(c)
    return plan.agg(
        F.count("*").alias("scanned"), one(F.col("decision") == "PARSE").alias("parsed"), one(F.col("decision") == "REUSE").alias("reused"), one(F.col("parse_status").isin("PARTIAL", "FAILED")).alias("degraded"),
        one(F.col("parse_status") == "FAILED").alias("failed"), one(F.col("parse_status") == "UNSUPPORTED").alias("unsupported"),
    )


def restamp(spark, folder):
    return changes.restamp(table(spark, folder, "code_symbols").select("id", "model_version").distinct(), F.lit("mv_next")).distinct()


def _intervals(spark, folder):
    s = table(spark, folder, "code_symbols").select("id", "file_id", F.upper(F.trim("symbol_type")).alias("symbol_type"), "location").distinct()
    at = lambda end: nesting.offset(F.col(f"location.{end}_line"), F.col(f"location.{end}_col"))
    return s.select(F.col("file_id").alias("key"), "id", at("start").alias("start"), at("end").alias("end"), "symbol_type").dropDuplicates(["key", "id", "start", "end"])


def nesting_parents(spark, folder):
    return nesting.innermost(_intervals(spark, folder))


def enclosing_lookup(spark, folder):
    """The innermost class or module around the start of each function and method."""
    rows = _intervals(spark, folder)
    points = rows.where("symbol_type in ('FUNCTION', 'METHOD')").withColumn("end", F.col("start"))
    return nesting.innermost(rows.where("symbol_type in ('CLASS', 'MODULE')"), points)


def doc_attach(spark, folder):
    """Of each class or module the signature of the earliest function or method directly in it."""
    rows = _intervals(spark, folder)
    names = table(spark, folder, "code_symbols").groupBy("id").agg(F.min("name").alias("text"))
    docs = rows.where("symbol_type in ('FUNCTION', 'METHOD')").withColumn("end", F.col("start")).join(names, "id")
    return nesting.attach_docs(docs, rows.where("symbol_type in ('CLASS', 'MODULE')"))


def validate_files(spark, folder):
    return validate.file_problems(table(spark, folder, "file_records").distinct())


def _faulty_symbols(spark, folder):
    """The symbols, of which some get a fault by the length of their name."""
    s = table(spark, folder, "code_symbols").distinct()
    k, loc = F.pmod(F.length("name"), F.lit(9)), F.col("location")
    broken = F.struct(F.when(k == 5, 0).otherwise(loc["start_line"]).alias("start_line"), F.when(k == 6, -1).otherwise(loc["start_col"]).alias("start_col"), F.when(k == 7, 0).otherwise(loc["end_line"]).alias("end_line"), F.when(k == 8, -2).otherwise(loc["end_col"]).alias("end_col"))
    return s.withColumns({"qualified_name": F.when(k == 2, F.replace("qualified_name", F.lit(":"), F.lit("."))).otherwise(F.col("qualified_name")), "file_id": F.when(k == 3, None).otherwise(F.col("file_id")), "model_version": F.when(k == 4, "").otherwise(F.col("model_version")), "location": broken}).withColumn("name", F.when(k == 1, "").otherwise(F.col("name")))


def validate_symbols(spark, folder):
    return validate.symbol_problems(_faulty_symbols(spark, folder))


def validate_chunks(spark, folder):
    c = table(spark, folder, "semantic_chunks").distinct()
    k = F.pmod(F.length("text"), F.lit(7))
    faulty = {"symbol_id": F.when(k == 1, None).otherwise(F.col("symbol_id")), "chunk_type": F.when(k == 3, "").otherwise(F.col("chunk_type")), "token_count": F.when(k == 4, -1).otherwise(F.col("token_count")), "model_version": F.when(k == 5, None).otherwise(F.col("model_version")), "text": F.when(k == 2, "").otherwise(F.col("text"))}
    return validate.chunk_problems(c.withColumns(faulty))


def validate_evidence(spark, folder):
    s = _faulty_symbols(spark, folder).select("id", "file_id", "location", "model_version").distinct()
    e = model.evidence_table(s)
    k = F.pmod(F.col("end_line"), F.lit(5))
    return validate.evidence_problems(e.withColumns({"score": F.when(k == 1, 1.5).when(k == 2, -0.5).otherwise(F.col("score")), "entity_id": F.when(k == 3, "").otherwise(F.col("entity_id"))}))


def _relationships(spark, folder):
    """Relationships with faults of every kind, derived from the symbols' ids."""
    s = table(spark, folder, "code_symbols").select("id", "file_id", "name", "signature", "location", "model_version").distinct()
    k = F.pmod(F.length("name"), F.lit(5))
    return s.select(
        F.concat(F.lit("rel_"), "id").alias("id"), F.col("id").alias("source_symbol_id"), F.when(k == 0, F.concat(F.lit("unresolved:call:"), "name")).otherwise(F.col("id")).alias("target_symbol_id"),
        F.when(k == 0, "UNRESOLVED").otherwise("RESOLVED_EXACT").alias("resolution_status"), F.when(k == 1, 0.5).when(k == 2, 1.5).when(k == 0, 0.0).otherwise(1.0).alias("confidence"), F.col("location").alias("source_location"), F.col("signature").alias("target_name"), "model_version",
    )


def validate_relationships(spark, folder):
    return validate.relationship_problems(_relationships(spark, folder))


def validation_report(spark, folder):
    """Everything wrong with a model of faulty tables: rules, references and repeated ids of all five tables."""
    files, symbols, chunks = table(spark, folder, "file_records").distinct(), _faulty_symbols(spark, folder), table(spark, folder, "semantic_chunks").distinct()
    evidence = model.evidence_table(symbols.select("id", "file_id", "location", "model_version").distinct())
    return validate.model_problems(files, symbols, _relationships(spark, folder), evidence, chunks)


def dangling_references(spark, folder):
    symbols, files = table(spark, folder, "code_symbols").select("id", "file_id").distinct(), table(spark, folder, "file_records")
    chunks = table(spark, folder, "semantic_chunks").select("id", "symbol_id").distinct()
    code = files.where("upper(language) = 'PYTHON'")
    return validate.dangling(symbols, "symbol", "id", "file_id", code).unionByName(validate.dangling(chunks, "chunk", "id", "symbol_id", symbols.join(code.select(F.col("id").alias("file_id")).distinct(), "file_id", "left_semi")))


def duplicate_ids(spark, folder):
    out = None
    for name, kind in (("file_records", "file"), ("code_symbols", "symbol"), ("semantic_chunks", "chunk")):
        one = validate.duplicates(table(spark, folder, name), kind)
        out = one if out is None else out.unionByName(one)
    return out


def valid_symbols(spark, folder):
    return validate.valid_and_rejected(_faulty_symbols(spark, folder).select("id", "name", "qualified_name", "symbol_type", "file_id", "model_version", "location").distinct())[0].select("id").distinct()


def model_counts(spark, folder):
    f, s, c = (table(spark, folder, t).distinct() for t in ("file_records", "code_symbols", "semantic_chunks"))
    return model.counts(f, s, _relationships(spark, folder), s, c, table(spark, folder, "excluded_files"))


def status_histogram(spark, folder):
    return table(spark, folder, "file_records").distinct().groupBy("parse_status").agg(F.count("*").alias("n"))


def claim_validation(spark, folder):
    """Each repository's claim that its chunks describe symbols of Python files, held against the symbols."""
    chunks = table(spark, folder, "semantic_chunks").select("repo", "id", "symbol_id").distinct()
    claims = chunks.select(F.col("repo").alias("answer_id"), F.col("id").alias("source"), F.lit("DESCRIBES").alias("kind"), F.col("symbol_id").alias("target"))
    known = table(spark, folder, "code_symbols").where("lower(language) = 'python'").select(F.col("id").alias("symbol_id")).distinct()
    edges = chunks.join(known, "symbol_id").select(F.col("id").alias("source"), F.lit("DESCRIBES").alias("kind"), F.col("symbol_id").alias("target"))
    return validate.claim_verdicts(claims, edges)


def degraded_files(spark, folder):
    return lookups.degraded_files(table(spark, folder, "file_records")).select("id", "parse_status").distinct()


def source_files(spark, folder):
    return lookups.source_files(table(spark, folder, "file_records")).select("id", "file_kind").distinct()


def unresolved_edges(spark, folder):
    return lookups.unresolved(_relationships(spark, folder)).select("id", "target_symbol_id").distinct()


QUERIES = {
    f.__name__: f
    for f in (change_detect, change_stats, scheduled_paths, rename_pairs, reuse_plan, restamp, nesting_parents, enclosing_lookup, doc_attach, validate_files, validate_symbols, validate_chunks, validate_evidence, validate_relationships, validation_report, run_counters, dangling_references, duplicate_ids, valid_symbols, model_counts, status_histogram, claim_validation, degraded_files, source_files, unresolved_edges)
}

_ENDS = r"""
with plain as (
  select repo, snapshot_no, regexp_replace(regexp_replace(path, '[\\/]+', '/', 'g'), '^(\./)+', '') as path,
         nullif(trim(regexp_replace(lower(trim(content_hash)), '^sha256:', '')), '') as digest, loaded_at
  from manifest_entries where repo is not null and snapshot_no is not null),
held as (
  select repo, snapshot_no, path, coalesce(digest, '') as h from plain where path <> ''
  qualify row_number() over (partition by repo, snapshot_no, path order by loaded_at desc nulls last, digest desc nulls last) = 1),
ends as (select repo, min(snapshot_no) as lo, max(snapshot_no) as hi from plain group by repo),
old as (select repo || '/' || path as path, h from held join ends using (repo) where snapshot_no = lo),
new as (select repo || '/' || path as path, h from held join ends using (repo) where snapshot_no = hi),
gone as (select path, h, row_number() over (partition by h order by path) as k from old where path not in (select path from new)),
came as (select path, h, row_number() over (partition by h order by path) as k from new where path not in (select path from old)),
moved as (select g.path as old_path, c.path as new_path, g.h from gone g join came c on g.h = c.h and g.k = c.k and g.h <> ''),
delta as (
  select c.path, case when m.old_path is null then 'NEW' else 'RENAMED' end as kind, m.old_path from came c left join moved m on m.new_path = c.path
  union all select path, 'DELETED', null from gone where path not in (select old_path from moved)
  union all select o.path, case when o.h = n.h and o.h <> '' then 'UNCHANGED' else 'CHANGED' end, null from old o join new n on o.path = n.path)
"""
_SCANS = """
with r as (select distinct id as path, coalesce(content_hash, '') as content_hash, parse_status, parse_error, node_count, max_depth, scanned_at from file_records),
first as (select * from r qualify row_number() over (partition by path order by scanned_at nulls first, content_hash nulls first, parse_status nulls first, parse_error nulls first, node_count nulls first, max_depth nulls first) = 1),
last as (select * from r qualify row_number() over (partition by path order by scanned_at desc nulls last, content_hash desc nulls last, parse_status desc nulls last, parse_error desc nulls last, node_count desc nulls last, max_depth desc nulls last) = 1)
"""
_AT = "location.{e}_line::bigint * 2147483648 + location.{e}_col"
_INTERVALS = f"""
with i as (select distinct file_id as key, id, {_AT.format(e='start')} as s, {_AT.format(e='end')} as e, upper(trim(symbol_type)) as t from code_symbols)
"""


def _rules(kind: str, rules: dict[str, str], source: str) -> str:
    return " union all ".join(f"select '{kind}' as entity_kind, id as entity_id, '{name}' as rule from {source} where {cond}" for name, cond in rules.items())


_SPAN_RULES = {"start_line": "{l}.start_line < 1", "end_line": "{l}.end_line < 1", "start_col": "{l}.start_col < 0", "end_col": "{l}.end_col < 0", "order": "({l}.end_line, {l}.end_col) < ({l}.start_line, {l}.start_col)"}
_REL = """(select 'rel_' || id as id, id as source_symbol_id, case when length(name) % 5 = 0 then 'unresolved:call:' || name else id end as target_symbol_id,
  case when length(name) % 5 = 0 then 'UNRESOLVED' else 'RESOLVED_EXACT' end as resolution_status,
  case length(name) % 5 when 1 then 0.5 when 2 then 1.5 when 0 then 0.0 else 1.0 end as confidence, location as source_location, signature as target_name, model_version
  from (select distinct id, file_id, name, signature, location, model_version from code_symbols))"""
_FAULTY = """(select * replace (case when k = 1 then '' else name end as name, case when k = 2 then replace(qualified_name, ':', '.') else qualified_name end as qualified_name, case when k = 3 then null else file_id end as file_id,
  case when k = 4 then '' else model_version end as model_version, {'start_line': case when k = 5 then 0 else location.start_line end, 'start_col': case when k = 6 then -1 else location.start_col end,
  'end_line': case when k = 7 then 0 else location.end_line end, 'end_col': case when k = 8 then -2 else location.end_col end} as location) from (select distinct *, length(name) % 9 as k from code_symbols))"""
_FAULTY_CHUNKS = """(select * replace (case when k = 1 then null else symbol_id end as symbol_id, case when k = 2 then '' else text end as text, case when k = 3 then '' else chunk_type end as chunk_type,
  case when k = 4 then -1 else token_count end as token_count, case when k = 5 then null else model_version end as model_version) from (select distinct *, length(text) % 7 as k from semantic_chunks))"""
_SYMBOL_RULES = {
    "symbol.name.missing": "coalesce(name, '') = ''", "symbol.qualified_name.missing": "coalesce(qualified_name, '') = ''", "symbol.qualified_name.no_module": "symbol_type <> 'MODULE' and not contains(qualified_name, ':')",
    "file_id.missing": "coalesce(file_id, '') = ''", "version.missing": "coalesce(model_version, '') = ''", **{f"span.{k}": v.format(l="location") for k, v in _SPAN_RULES.items()},
}
ORACLES = {
    "change_detect": _ENDS + "select path, kind, old_path from delta",
    "change_stats": _ENDS + """select count(*) filter (kind = 'NEW') as new, count(*) filter (kind = 'CHANGED') as changed, count(*) filter (kind = 'DELETED') as deleted, count(*) filter (kind = 'RENAMED') as renamed,
  count(*) filter (kind = 'UNCHANGED') as unchanged, count(*) filter (kind in ('NEW', 'CHANGED', 'RENAMED')) as scheduled from delta""",
    "scheduled_paths": _ENDS + "select path from delta where kind in ('NEW', 'CHANGED', 'RENAMED')",
    "rename_pairs": _ENDS + "select old_path, new_path, h as content_hash from moved",
    "reuse_plan": _SCANS + """select l.path, case when u then 'REUSE' else 'PARSE' end as decision, case when u then f.parse_status else l.parse_status end as parse_status, case when u then f.parse_error else l.parse_error end as parse_error,
  case when u then f.node_count else l.node_count end as node_count, case when u then f.max_depth else l.max_depth end as max_depth
  from last l join first f using (path), lateral (select l.content_hash = f.content_hash and l.content_hash <> '' as u)""",
    "restamp": "select distinct id, 'mv_next' as model_version from code_symbols",
    "nesting_parents": _INTERVALS + """select a.key, a.id, p.parent from i a left join (
  select x.key, x.id, x.s, x.e, arg_max(y.id, (y.s, -y.e, y.id)) as parent from i x join i y on y.key = x.key and y.s <= x.s and y.e >= x.e and (y.s, -y.e, y.id) < (x.s, -x.e, x.id) group by all) p
  on p.key = a.key and p.id = a.id and p.s = a.s and p.e = a.e""",
    "enclosing_lookup": _INTERVALS + """select a.key, a.id, p.parent from (select * from i where t in ('FUNCTION', 'METHOD')) a left join (
  select x.key, x.id, x.s, arg_max(y.id, (y.s, -y.e, y.id)) as parent from i x join i y on y.key = x.key and y.s <= x.s and y.e >= x.s where x.t in ('FUNCTION', 'METHOD') and y.t in ('CLASS', 'MODULE') group by all) p
  on p.key = a.key and p.id = a.id and p.s = a.s""",
    "doc_attach": _INTERVALS + """, names as (select id, min(name) as name from code_symbols group by id),
  owned as (select x.id as doc, x.s, arg_max(y.id, (y.s, -y.e, y.id)) as id from i x join i y on y.key = x.key and y.s <= x.s and y.e >= x.s where x.t in ('FUNCTION', 'METHOD') and y.t in ('CLASS', 'MODULE') group by all)
  select o.id, arg_min(n.name, (o.s, o.doc)) as documentation from owned o join names n on n.id = o.doc group by o.id""",
    "validate_files": _rules("file", {
        "file.path.missing": "coalesce(path, '') = ''", "file.path.absolute": "starts_with(path, '/') or starts_with(path, chr(92)) or contains(path, ':')", "file.path.backslash": "contains(path, chr(92))",
        "file.hash.missing": "coalesce(content_hash, '') = ''", "file.size.negative": "size < 0", "version.missing": "coalesce(model_version, '') = ''",
        "file.failure.unexplained": "parse_status = 'FAILED' and coalesce(parse_error, '') = ''", "file.source.no_language": "file_kind = 'SOURCE' and language is null"}, "(select distinct * from file_records)"),
    "validate_symbols": _rules("symbol", _SYMBOL_RULES, _FAULTY),
    "validate_chunks": _rules("chunk", {"chunk.symbol.missing": "coalesce(symbol_id, '') = ''", "chunk.text.missing": "coalesce(text, '') = ''", "chunk.type.missing": "coalesce(chunk_type, '') = ''", "chunk.tokens.negative": "token_count < 0", "version.missing": "coalesce(model_version, '') = ''"}, _FAULTY_CHUNKS),
    "validate_relationships": _rules("relationship", {
        "relationship.source.missing": "coalesce(source_symbol_id, '') = ''", "relationship.target.missing": "coalesce(target_symbol_id, '') = ''", "relationship.confidence.range": "not (confidence between 0 and 1)",
        "relationship.exact.unsure": "resolution_status = 'RESOLVED_EXACT' and confidence < 1", "relationship.unresolved.sure": "resolution_status = 'UNRESOLVED' and confidence > 0",
        "relationship.unresolved.nameless": "starts_with(target_symbol_id, 'unresolved:') and coalesce(target_name, '') = ''", "version.missing": "coalesce(model_version, '') = ''",
        **{f"span.{k}": v.format(l="source_location") for k, v in _SPAN_RULES.items()}}, _REL),
    "dangling_references": """with code as (select id from file_records where upper(language) = 'PYTHON'), s as (select distinct id, file_id from code_symbols)
  select 'symbol' as entity_kind, id as entity_id, 'dangling.file_id' as rule from s where file_id is not null and file_id not in (select id from code)
  union all select 'chunk', id, 'dangling.symbol_id' from (select distinct id, symbol_id from semantic_chunks) where symbol_id is not null and symbol_id not in (select id from s where file_id in (select id from code))""",
    "duplicate_ids": " union all ".join(f"select '{k}' as entity_kind, id as entity_id, 'id.repeated' as rule from {t} group by id having count(*) > 1" for t, k in (("file_records", "file"), ("code_symbols", "symbol"), ("semantic_chunks", "chunk"))),
    "valid_symbols": "select distinct id from code_symbols where id not in (select entity_id from (" + _rules("symbol", _SYMBOL_RULES, _FAULTY) + "))",
    "model_counts": f"""select 'files' as entity, count(*) as n from (select distinct * from file_records) union all select 'symbols', count(*) from (select distinct * from code_symbols) union all select 'relationships', count(*) from {_REL}
  union all select 'evidence', count(*) from (select distinct * from code_symbols) union all select 'chunks', count(*) from (select distinct * from semantic_chunks) union all select 'diagnostics', count(*) from excluded_files
  union all select 'degraded_files', count(*) from (select distinct * from file_records) where parse_status in ('PARTIAL', 'FAILED')""",
    "status_histogram": "select parse_status, count(*) as n from (select distinct * from file_records) group by parse_status",
    "claim_validation": """with c as (select distinct repo, id, symbol_id from semantic_chunks), k as (select distinct id as symbol_id from code_symbols where lower(language) = 'python'),
  g as (select repo as answer_id, count(id) as claims, count(k.symbol_id) as grounded from c left join k using (symbol_id) group by repo)
  select *, case when claims = 0 then 'INSUFFICIENT' when claims = grounded then 'PASS' else 'FAIL' end as verdict, round(grounded / claims, 6) as score from g""",
}
ORACLES["degraded_files"] = "select distinct id, parse_status from file_records where parse_status in ('PARTIAL', 'FAILED')"
ORACLES["source_files"] = "select distinct id, file_kind from file_records where file_kind = 'SOURCE'"
ORACLES["unresolved_edges"] = f"select distinct id, target_symbol_id from {_REL} where starts_with(target_symbol_id, 'unresolved:')"
ORACLES["validate_evidence"] = f"""with b as (select 'ev_' || left(sha1(coalesce(id, '') || chr(31) || coalesce(file_id, '') || chr(31) || location.start_line || chr(31) || location.end_line || chr(31) || 'offline.ast'), 16) as id, id as entity_id, file_id, location.start_line as s, location.end_line as e, model_version
  from (select distinct id, file_id, location, model_version from {_FAULTY})),
  e as (select * replace (case when (e % 5) = 3 then '' else entity_id end as entity_id), case e % 5 when 1 then 1.5 when 2 then -0.5 else 1.0 end as score from b)
""" + " union all ".join(f"select 'evidence' as entity_kind, id as entity_id, '{k}' as rule from e where {v}" for k, v in {"evidence.lines.start": "s < 1", "evidence.lines.order": "e < s", "evidence.entity.missing": "coalesce(entity_id, '') = ''", "file_id.missing": "coalesce(file_id, '') = ''", "version.missing": "coalesce(model_version, '') = ''", "evidence.score.range": "score not between 0 and 1"}.items())
ORACLES["run_counters"] = f"""with p as ({ORACLES['reuse_plan']}) select count(*) as scanned, count(*) filter (decision = 'PARSE') as parsed, count(*) filter (decision = 'REUSE') as reused,
  count(*) filter (parse_status in ('PARTIAL', 'FAILED')) as degraded, count(*) filter (parse_status = 'FAILED') as failed, count(*) filter (parse_status = 'UNSUPPORTED') as unsupported from p"""
_CHUNK_RULES = {"chunk.symbol.missing": "coalesce(symbol_id, '') = ''", "chunk.text.missing": "coalesce(text, '') = ''", "chunk.type.missing": "coalesce(chunk_type, '') = ''", "chunk.tokens.negative": "token_count < 0", "version.missing": "coalesce(model_version, '') = ''"}
_EVIDENCE_RULES = {"evidence.lines.start": "start_line < 1", "evidence.lines.order": "end_line < start_line", "evidence.entity.missing": "coalesce(entity_id, '') = ''", "file_id.missing": "coalesce(file_id, '') = ''", "version.missing": "coalesce(model_version, '') = ''", "evidence.score.range": "score not between 0 and 1"}
_dangling = lambda kind, source, column, target, extra="true": f"select '{kind}' as entity_kind, id as entity_id, 'dangling.{column}' as rule from {source} where {column} is not null and {extra} and {column} not in (select id from {target} where id is not null)"
ORACLES["validation_report"] = f"""with fr as (select distinct * from file_records), sy as (select * from {_FAULTY}), re as (select * from {_REL}), ch as (select distinct * from semantic_chunks),
  ev as (select 'ev_' || left(sha1(coalesce(id, '') || chr(31) || coalesce(file_id, '') || chr(31) || location.start_line || chr(31) || location.end_line || chr(31) || 'offline.ast'), 16) as id, id as entity_id, file_id, location.start_line as start_line, location.end_line as end_line, 1.0 as score, model_version
    from (select distinct id, file_id, location, model_version from sy))
""" + " union all ".join([
    ORACLES["validate_files"].replace("(select distinct * from file_records)", "fr"), _rules("symbol", _SYMBOL_RULES, "sy"), ORACLES["validate_relationships"].replace(_REL, "re"), _rules("evidence", _EVIDENCE_RULES, "ev"), _rules("chunk", _CHUNK_RULES, "ch"),
    _dangling("symbol", "sy", "file_id", "fr"), _dangling("relationship", "re", "source_symbol_id", "sy"), _dangling("relationship", "re", "target_symbol_id", "sy", "not starts_with(target_symbol_id, 'unresolved:')"),
    _dangling("evidence", "ev", "file_id", "fr"), _dangling("evidence", "ev", "entity_id", "sy"), _dangling("chunk", "ch", "symbol_id", "sy"),
    *(f"select '{kind}' as entity_kind, id as entity_id, 'id.repeated' as rule from {t} group by id having count(*) > 1" for kind, t in (("file", "fr"), ("symbol", "sy"), ("relationship", "re"), ("evidence", "ev"), ("chunk", "ch"))),
])
