"""Queries of the scan: manifest, identifiers, classification, ledger, versions, text functions."""

from pyspark.sql import functions as F

from quarry.functions import ids, languages, spans, text
from quarry.operators import model
from quarry.sources import repository, store
from quarry.sources.tables import table


def _corpus(spark, folder):
    """The corpus as scanned files: path (with its repository), content, length."""
    return table(spark, folder, "corpus").select("file_id", F.concat_ws("/", "repo", "path").alias("path"), F.col("content"), F.col("length"))


def snapshot_manifest(spark, folder):
    c = table(spark, folder, "corpus")
    return c.select(
        "file_id", ids.file_id("path").alias("path_id"), ids.content_hash("content").alias("content_hash"), "length", text.line_count("content").alias("line_count"),
        text.estimate_tokens("content").alias("tokens"), text.module_path("path").alias("module_path"), text.module_name(text.module_path("path")).alias("module_name"), languages.detect(F.col("path")).alias("language"),
    )


def classify_files(spark, folder):
    return repository.classify(_corpus(spark, folder)).select("path", "language", "pruned", "decision", "parse_status", "file_kind")


#: A scan that keeps generated files, and leaves out only what is named here.
OPTIONS = repository.ScanOptions(directories=("vendor", "Tests"), suffixes=(".min.js", ".go"), filenames=("index.py",), detect_generated=False, detect_binary=False)


def classify_with_options(spark, folder):
    return repository.classify(_corpus(spark, folder), OPTIONS).select("path", "language", "pruned", "decision", "parse_status", "file_kind")


def exclusion_ledger(spark, folder):
    return repository.exclusion_ledger(repository.classify(_corpus(spark, folder)))


def exclusion_counts(spark, folder):
    return repository.exclusion_counts(exclusion_ledger(spark, folder))


def language_histogram(spark, folder):
    return repository.language_histogram(repository.file_records(repository.classify(_corpus(spark, folder))))


def file_records(spark, folder):
    return repository.file_records(repository.classify(_corpus(spark, folder)), F.lit("mv_0"))


def model_version(spark, folder):
    return ids.version_id(table(spark, folder, "corpus").select(ids.content_hash("content").alias("content_hash")))


def tree_version(spark, folder):
    return ids.tree_version_id(table(spark, folder, "corpus").select(ids.content_hash("content").alias("content_hash")))


def registry_summary(spark, folder):
    return languages.summary(spark)


def registry_lookup(spark, folder):
    """What the registry says of the language of each path of the ledger and the corpus."""
    paths = table(spark, folder, "excluded_files").select("path").unionByName(table(spark, folder, "corpus").select("path")).distinct()
    found = paths.select("path", languages.detect(F.col("path")).alias("language"))
    return found.select("path", "language", languages.display_name(F.col("language")).alias("display_name"), languages.is_code(F.col("language")).alias("is_code"), languages.is_extractable(F.col("language")).alias("is_extractable"))


def registry_check(spark, folder):
    """What our registry says of each extension of the table of languages."""
    e = table(spark, folder, "language_registry").select(F.lower("extension").alias("extension")).distinct()
    found = e.select("extension", languages.detect(F.concat(F.lit("x"), "extension")).alias("language"))
    return found.select("extension", F.lower("language").alias("language"), languages.is_code(F.col("language")).alias("is_code"))


def signature_doc_clean(spark, folder):
    s = table(spark, folder, "code_symbols").select("id", "documentation", "signature").distinct()
    return s.select("id", text.clean_doc("documentation").alias("documentation"), text.signature_of("signature").alias("signature"), text.looks_like_identifier("signature").alias("is_identifier")).distinct()


def chunk_signatures(spark, folder):
    return table(spark, folder, "semantic_chunks").select("id", text.signature_of("text").alias("signature"), text.estimate_tokens("text").alias("tokens"), text.hash_text("text").alias("text_hash")).distinct()


def line_slices(spark, folder):
    """The whole lines of each symbol, cut from its file: their hash and size."""
    s = table(spark, folder, "code_symbols").select("id", "file_id", "location.start_line", "location.end_line").distinct()
    lines = table(spark, folder, "corpus").select("file_id", text.lines("content").alias("lines"))
    cut = F.array_join(F.slice("lines", F.greatest(F.lit(1), F.col("start_line")), F.greatest(F.lit(0), F.col("end_line") - F.greatest(F.lit(1), F.col("start_line")) + 1)), "\n")
    return s.join(lines, "file_id").select("id", cut.alias("t")).select("id", text.hash_text("t").alias("content_hash"), F.length("t").alias("chars"), text.estimate_tokens("t").alias("tokens"))


def span_functions(spark, folder):
    loc = F.col("location")
    s = table(spark, folder, "code_symbols").select("id", "location").distinct()
    return s.select("id", spans.line_count(loc).alias("line_count"), spans.contains_line(loc, F.lit(10)).alias("has_line_10"), spans.is_zero_width(loc).alias("zero_width"), spans.text(loc).alias("span_text"))


def evidence(spark, folder):
    return model.evidence_table(table(spark, folder, "code_symbols").select("id", "file_id", "location", "model_version").distinct())


def entity_ids(spark, folder):
    s = table(spark, folder, "code_symbols").select("id", "file_id", "symbol_type", "qualified_name", "signature", "location").distinct()
    line, col = F.col("location.start_line"), F.col("location.start_col")
    return s.select("id", ids.symbol_id("file_id", "symbol_type", "qualified_name").alias("symbol_key"), ids.relationship_id("id", F.lit("CALLS"), "signature", line, col).alias("relationship_key"), ids.chunk_id("id", F.lower("symbol_type")).alias("chunk_key"))


def overload_ids(spark, folder):
    """Ids of symbols whose qualified names repeat within a file."""
    s = table(spark, folder, "code_symbols").select(F.col("id").alias("symbol"), "file_id", "symbol_type", "qualified_name", "signature", "location").distinct()
    named = model.overload_names(s, "file_id").withColumn("id", ids.symbol_id("file_id", "symbol_type", "id_name"))
    return model.ordinal_suffix(named.withColumn("start_line", F.col("location.start_line")), "id", "start_line", "symbol").select("symbol", "id", "id_name", "group_size")


def table_digests(spark, folder):
    """An order-free digest of each table of the model."""
    out = None
    for name in ("corpus", "code_symbols", "semantic_chunks", "file_records", "excluded_files"):
        one = store.table_digest(table(spark, folder, name)).select(F.lit(name).alias("name"), "digest")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (snapshot_manifest, classify_files, classify_with_options, exclusion_ledger, exclusion_counts, language_histogram, file_records, model_version, tree_version, registry_summary, registry_lookup, registry_check, signature_doc_clean, chunk_signatures, line_slices, span_functions, evidence, entity_ids, overload_ids, table_digests)}


def _sid(prefix: str, *parts: str) -> str:
    """SQL of a content-addressed id."""
    return f"'{prefix}' || left(sha1(" + " || chr(31) || ".join(f"coalesce({p}::varchar, '')" for p in parts) + "), 16)"


def _list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _language_sql(path: str) -> str:
    names, exts = {}, {}
    for key, _, e, n, _, _ in languages.rows():
        for x in n:
            names.setdefault(x, key)
        for x in e:
            exts.setdefault(x.lower(), key)
    case = lambda d, k: f"case {k} " + " ".join(f"when '{a}' then '{b}'" for a, b in d.items()) + " end"
    name = f"regexp_extract({path}, '([^/]*)$', 1)"
    return f"coalesce({case(names, name)}, {case(names, f'lower({name})')}, {case(exts, f"regexp_extract(lower({name}), '^.+([.][^.]*)$', 1)")})"


_CODE = [r[0] for r in languages.rows() if r[4]]
_LINES = "(length({t}) - length(replace({t}, chr(10), '')) + case when {t} <> '' and not ends_with({t}, chr(10)) then 1 else 0 end)"
_TOKENS = "(case when {t} = '' then 0 else greatest(1, length({t}) // 4) end)"
_PARTS = r"list_filter(string_split(regexp_replace(path, '\.[^./]*$', ''), '/'), lambda x: x <> '')"
_MODULE = f"""(case when list_extract({_PARTS}, -1) in ('__init__', 'index', 'mod') then array_to_string(({_PARTS})[:-2], '.') else array_to_string({_PARTS}, '.') end)"""
_IGNORED = "|".join(s.replace(".", r"\.") for s in repository.IGNORED_SUFFIXES)
_GEN = " or ".join(f"contains(head, '{m}')" for m in repository.GENERATED_MARKERS)
_GEN_SUFFIX = "|".join(s.replace(".", r"\.") for s in repository.GENERATED_SUFFIXES)
_DIRS = _list(d.lower() for d in repository.IGNORED_DIRECTORIES)
#: Here the head is 8192 characters, not bytes.
CLASSIFIED = f"""
with base as (
  select repo || '/' || path as path, content, length, string_split(repo || '/' || path, '/') as parts,
         left(content, 8192) as head
  from (select repo, path, content, length from corpus)),
named as (
  select *, {_language_sql('path')} as language, list_extract(parts, -1) as name,
         list_position(list_transform(parts[:-2], lambda p: lower(p) in {_DIRS}), true) as pos
  from base),
classified as (
  select path, content, length, language, case when pos > 0 then array_to_string(parts[:pos], '/') end as pruned,
    case when pos > 0 then 'PRUNED'
         when name in {_list(repository.IGNORED_FILENAMES)} or regexp_matches(lower(name), '({_IGNORED})$') then 'IGNORED'
         when content is null then 'UNREADABLE'
         when contains(head, chr(0)) then 'BINARY'
         when regexp_matches(lower(path), '{"|".join(repository.GENERATED_PATHS)}') or regexp_matches(lower(path), '({_GEN_SUFFIX})$') or {_GEN} then 'GENERATED'
         else 'KEPT' end as decision
  from named)
"""

_STATUS = f"""case when decision = 'UNREADABLE' then 'FAILED' when decision <> 'KEPT' then null when language is null or language not in {_list(_CODE)} then 'UNSUPPORTED' when length = 0 then 'EMPTY' else 'OK' end"""
_KIND = f"""case when decision in ('BINARY', 'GENERATED') then decision when decision in ('PRUNED', 'IGNORED') then 'IGNORED' when language in {_list(_CODE)} then 'SOURCE' else 'UNSUPPORTED' end"""
_LEDGER = """ledger as (
  select path, decision as reason, case when decision = 'IGNORED' then 0 else length end as size from classified where decision in ('IGNORED', 'BINARY', 'GENERATED')
  union all select distinct pruned, 'IGNORED', 0 from classified where decision = 'PRUNED')
"""
_bag = lambda d: "sha256(count(*) || ',' || " + " || ',' || ".join(f"sum(('0x' || substr({d}, {8 * i + 1}, 8))::bigint)" for i in range(8)) + ")"
#: Of each table the columns in alphabetical order, as a struct; times as the JSON writer spells them.
_FIELDS = {
    t: ", ".join(f"'{c}': " + (f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%g')" if c.endswith("_at") else c) for c in columns.split())
    for t, columns in {
        "corpus": "content file_id length path repo",
        "code_symbols": "content_hash documentation file_id id language location model_version name qualified_name repo signature symbol_type",
        "semantic_chunks": "chunk_type embedding_id id model_version repo symbol_id text token_count",
        "file_records": "content_hash file_kind id is_binary is_generated language line_count max_depth model_version node_count parse_error parse_status path repo scanned_at size",
        "excluded_files": "model_version path reason repo size",
    }.items()
}
_SPLIT = r"string_split_regex({t}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
_STRIP = r"regexp_replace({t}, '^\s+|\s+$', '', 'g')"

ORACLES = {
    "snapshot_manifest": f"""select file_id, {_sid('file_', 'path')} as path_id, 'sha256:' || sha256(content) as content_hash, length, {_LINES.format(t='content')}::int as line_count,
  {_TOKENS.format(t='content')}::int as tokens, {_MODULE} as module_path, regexp_extract({_MODULE}, '([^.]*)$', 1) as module_name, {_language_sql('path')} as language from corpus""",
    "classify_files": CLASSIFIED + f"select path, language, pruned, decision, {_STATUS} as parse_status, {_KIND} as file_kind from classified",
    "classify_with_options": f"""with base as (select repo || '/' || path as path, content, length, string_split(repo || '/' || path, '/') as parts from corpus),
  named as (select *, {_language_sql('path')} as language, list_extract(parts, -1) as name, list_position(list_transform(parts[:-2], lambda p: lower(p) in ('vendor', 'tests')), true) as pos from base),
  classified as (select *, case when pos > 0 then array_to_string(parts[:pos], '/') end as pruned, case when pos > 0 then 'PRUNED' when name = 'index.py' or regexp_matches(lower(name), '([.]min[.]js|[.]go)$') then 'IGNORED' when content is null then 'UNREADABLE' else 'KEPT' end as decision from named)
  select path, language, pruned, decision, {_STATUS} as parse_status, {_KIND} as file_kind from classified""",
    "exclusion_ledger": CLASSIFIED + ", " + _LEDGER + "select path, reason, size::bigint as size from ledger",
    "exclusion_counts": CLASSIFIED + ", " + _LEDGER + "select reason, count(*) as n from ledger group by reason",
    "language_histogram": CLASSIFIED + "select language, count(*) as n from classified where decision in ('KEPT', 'UNREADABLE') and language is not null group by language",
    "file_records": CLASSIFIED
    + f"""select {_sid('file_', 'path')} as id, path, language, 'sha256:' || sha256(content) as content_hash, length as size, {_STATUS} as parse_status, null::varchar as parse_error, 'mv_0' as model_version,
  {_KIND} as file_kind, false as is_binary, false as is_generated, {_LINES.format(t='content')}::int as line_count, 0 as node_count, 0 as max_depth from classified where decision in ('KEPT', 'UNREADABLE')""",
    "model_version": "select 'mv_' || left(sha1(sha256(string_agg(h, chr(10) order by h))), 16) as model_version from (select 'sha256:' || sha256(content) as h from corpus)",
    "tree_version": f"select 'mv_' || left(sha1({_bag('d')}), 16) as model_version from (select sha256('sha256:' || sha256(content)) as d from corpus)",
    "table_digests": " union all ".join(f"select '{t}' as name, {_bag('d')} as digest from (select sha256(to_json({{{fields}}})) as d from {t})" for t, fields in _FIELDS.items()),
    "registry_summary": f"select {len(languages.rows())} as registered, {len(_CODE)} as code_languages, {len({e.lower() for r in languages.rows() for e in r[2]})} as extensions, {len({n for r in languages.rows() for n in r[3]})} as filenames, {sum(r[5] for r in languages.rows())} as extractable",
    "registry_check": "select distinct lower(extension) as extension, lower(language) as language, is_code from language_registry",
    "registry_lookup": f"""select path, language, coalesce(case language {" ".join(f"when '{r[0]}' then '{r[1]}'" for r in languages.rows())} end, 'Unknown') as display_name,
  coalesce(language in {_list(_CODE)}, false) as is_code, coalesce(language in {_list(r[0] for r in languages.rows() if r[5])}, false) as is_extractable
  from (select path, {_language_sql('path')} as language from (select path from excluded_files union select path from corpus))""",
    "line_slices": f"""with l as (select file_id, {_SPLIT.format(t='content')} as p from corpus), k as (select file_id, case when p[-1] = '' then p[:-2] else p end as lines from l),
  s as (select distinct id, file_id, location from code_symbols),
  c as (select id, array_to_string(lines[greatest(1, location.start_line):location.end_line], chr(10)) as t from s join k using (file_id))
  select id, 'sha256:' || sha256(t) as content_hash, length(t) as chars, {_TOKENS.format(t='t')}::int as tokens from c""",
    "span_functions": """select distinct id, location.end_line - location.start_line + 1 as line_count, location.start_line <= 10 and 10 <= location.end_line as has_line_10,
  location.start_line = location.end_line and location.start_col = location.end_col as zero_width, location.start_line || ':' || location.start_col || '-' || location.end_line || ':' || location.end_col as span_text from code_symbols""",
    "evidence": f"""select {_sid('ev_', 'id', 'file_id', 'location.start_line', 'location.end_line', "'offline.ast'")} as id, id as entity_id, file_id, location.start_line as start_line, location.end_line as end_line,
  'offline.ast' as retrieval_source, 1.0::double as score, model_version from (select distinct id, file_id, location, model_version from code_symbols)""",
    "entity_ids": f"""select distinct id, {_sid('sym_', 'file_id', 'symbol_type', 'qualified_name')} as symbol_key, {_sid('rel_', 'id', "'CALLS'", 'signature', 'location.start_line', 'location.start_col')} as relationship_key,
  {_sid('chunk_', 'id', 'lower(symbol_type)')} as chunk_key from (select distinct id, file_id, symbol_type, qualified_name, signature, location from code_symbols)""",
    "overload_ids": f"""with s as (select distinct id as symbol, file_id, symbol_type, qualified_name, signature, location from code_symbols),
  g as (select *, count(*) over (partition by file_id, symbol_type, qualified_name) as group_size from s),
  n as (select *, case when group_size > 1 then qualified_name || '#' || left(sha1(coalesce(signature, '')), 6) else qualified_name end as id_name from g),
  i as (select *, {_sid('sym_', 'file_id', 'symbol_type', 'id_name')} as bare from n)
  select symbol, bare || case when k > 0 then '~' || k else '' end as id, id_name, group_size
  from (select *, row_number() over (partition by bare order by location.start_line, symbol) - 1 as k from i)""",
    "chunk_signatures": f"""with l as (select distinct id, text, list_filter(list_transform({_SPLIT.format(t='text')}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' and not regexp_matches(x, '^(@|#|\\[|//|/\\*|\\*)')) as k from semantic_chunks)
  select distinct id, coalesce(left(k[1], 200), '') as signature, {_TOKENS.format(t='text')}::int as tokens, 'sha256:' || sha256(text) as text_hash from l""",
    "signature_doc_clean": f"""with l as (select distinct id, documentation, signature, {_SPLIT.format(t='documentation')} as d, {_SPLIT.format(t='signature')} as s from code_symbols),
  k as (select *, case when d[-1] = '' then d[:-2] else d end as lines from l),
  m as (select *, list_transform(lines, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^(///|//!|//|/\\*\\*|/\\*|\\*|#|--|;;|%|\\\\)', ''), '^\\s+|\\s+$', '', 'g')) as bare from k),
  u as (select *, list_transform(bare, lambda x: regexp_replace(case
      when starts_with(x, '\"\"\"') and ends_with(x, '\"\"\"') and length(x) > 2 then substr(x, 4, greatest(0, length(x) - 6))
      when starts_with(x, repeat(chr(39), 3)) and ends_with(x, repeat(chr(39), 3)) and length(x) > 2 then substr(x, 4, greatest(0, length(x) - 6))
      when starts_with(x, chr(34)) and ends_with(x, chr(34)) and length(x) > 2 then substr(x, 2, length(x) - 2)
      when starts_with(x, chr(39)) and ends_with(x, chr(39)) and length(x) > 2 then substr(x, 2, length(x) - 2) else x end, '^\\s+|\\s+$', '', 'g')) as c from m),
  g as (select *, list_filter(list_transform(s, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' and not regexp_matches(x, '^(@|#|\\[|//|/\\*|\\*)')) as sig from u)
  select distinct id, case when documentation is null then null else left(regexp_replace(array_to_string(c, chr(10)), '^\\s+|\\s+$', '', 'g'), 1200) end as documentation,
  case when signature is null then null else coalesce(left(sig[1], 200), '') end as signature, regexp_matches(signature, '^[A-Za-z0-9_.$]+$') as is_identifier from g""",
}
