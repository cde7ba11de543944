"""Queries of syntax, graph, retrieval, resolution, answers and streams."""

import uuid

from pyspark.sql import functions as F

from quarry.functions import ids, text
from quarry.operators import answers, graph, lookups, model, resolve, retrieve, search, vectors
from quarry.plans.scan import _CODE, _MODULE, _language_sql, _list
from quarry.sources.tables import cut, ensure_checkpoint_dir, table
from quarry.streaming import feeds
from quarry.syntax.engine import parse_files
from quarry.syntax.facts import BINDINGS


def _parsed(spark, folder):
    return parse_files(table(spark, folder, "corpus").select(F.concat_ws("/", "repo", "path").alias("path"), "content"))


def parse_outcomes(spark, folder):
    return _parsed(spark, folder).select("path", "parse_status", "parse_error", "node_count", "max_depth", F.size("diagnostics").alias("diagnostics"))


def extract_symbols(spark, folder):
    return _parsed(spark, folder).select("path", F.explode("symbols").alias("s")).select("path", "s.ordinal", "s.name", "s.qualified_name", "s.symbol_type", "s.signature", "s.documentation", "s.parent", "s.span.start_line", "s.span.end_line")


def extract_imports(spark, folder):
    return _parsed(spark, folder).select("path", F.explode("imports").alias("i")).select("path", "i.module", "i.names", "i.alias", "i.enclosing", "i.span.start_line")


def extract_calls(spark, folder):
    return _parsed(spark, folder).select("path", F.explode("calls").alias("c")).select("path", F.concat_ws(".", "c.receiver", "c.callee").alias("target_name"), "c.enclosing", "c.span.start_line", "c.span.start_col")


def extract_inherits(spark, folder):
    return _parsed(spark, folder).select("path", F.explode("inherits").alias("i")).select("path", "i.base", "i.enclosing", "i.span.start_line")


def extract_bindings(spark, folder):
    return _parsed(spark, folder).select("path", F.explode("bindings").alias("b")).select("path", "b.name", "b.type_name", "b.scope", "b.enclosing", "b.span.start_line")


def parse_diagnostics(spark, folder):
    return model.diagnostic_table(_parsed(spark, folder))


def import_chunks(spark, folder):
    return _parsed(spark, folder).select("path", model.import_lines(F.col("imports")).alias("text"))


def extract_declared(spark, folder):
    """The declarations that the table of symbols knows and extraction finds, of those whose brackets match and whose
    name stands in a head: a symbol that is missing here was not found."""
    corpus = table(spark, folder, "corpus").select("file_id", F.concat_ws("/", "repo", "path").alias("path"), text.lines("content").alias("lines"))
    known = table(spark, folder, "code_symbols").select("file_id", "name", F.upper(F.trim("symbol_type")).alias("symbol_type"), "location.start_line", "location.end_line").distinct().where("symbol_type <> 'MODULE'")
    lines = F.array_join(F.slice("lines", F.col("start_line"), F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1)), "\n")
    cut_out = known.join(corpus, "file_id").select("path", "name", "symbol_type", lines.alias("t"))
    counted = lambda c: F.length("t") - F.length(F.replace("t", F.lit(c)))
    headed = F.contains("t", F.concat("name", F.lit("("))) | F.contains("t", F.concat(F.lit("class "), "name")) | F.contains("t", F.concat(F.lit("type "), "name")) | F.contains("t", F.concat("name", F.lit(" = "))) | F.contains("t", F.concat("name", F.lit("<")))
    sound = cut_out.where((counted("(") == counted(")")) & (counted("[") == counted("]")) & (counted("{") == counted("}")) & headed).select("path", "name", "symbol_type").distinct()
    found = _parsed(spark, folder).select("path", F.explode("symbols").alias("s")).select("path", "s.name", "s.symbol_type").distinct()
    return sound.join(found, ["path", "name", "symbol_type"], "left_semi")


def _table_facts(spark, folder):
    """Facts of files as a backend gives them, made of the table of symbols: every function calls itself once, every class
    inherits from itself and every file imports its own module, so each kind of edge is there."""
    from pyspark.sql import Window as W

    s = table(spark, folder, "code_symbols").where("qualified_name is not null").groupBy(F.col("file_id").alias("path"), "qualified_name", F.upper(F.trim("symbol_type")).alias("symbol_type"), "location").agg(F.min("name").alias("name"), F.min("signature").alias("signature"))
    order = W.partitionBy("path").orderBy(F.when(F.col("symbol_type") == "MODULE", 0).otherwise(1), "location", "qualified_name", "symbol_type")
    s = s.withColumn("ordinal", (F.row_number().over(order) - 1).cast("int")).withColumn("parent", F.when(F.col("ordinal") > 0, F.regexp_extract("qualified_name", r"^(.*)[.:][^.:]*$", 1)))
    lines = table(spark, folder, "corpus").select(F.col("file_id").alias("path"), text.lines("content").alias("lines"))
    whole = F.array_join(F.slice("lines", F.col("location.start_line"), F.greatest(F.lit(0), F.col("location.end_line") - F.col("location.start_line") + 1)), "\n")
    s = s.join(lines, "path").withColumn("slice", whole).drop("lines")
    symbol = F.struct("ordinal", "name", "qualified_name", "symbol_type", "signature", F.lit(None).cast("string").alias("documentation"), "parent", F.col("location").alias("span"), "slice")
    call = F.struct(F.col("name").alias("callee"), F.when(F.col("symbol_type") == "METHOD", "self").alias("receiver"), F.col("qualified_name").alias("enclosing"), F.col("location").alias("span"))
    base = F.struct(F.col("name").alias("base"), F.col("parent").alias("enclosing"), F.col("location").alias("span"))
    imported = F.struct(F.lit(0).alias("ordinal"), F.col("qualified_name").alias("module"), F.array("name").alias("names"), F.lit(None).cast("string").alias("alias"), F.lit(None).cast("string").alias("enclosing"), F.col("location").alias("span"))
    kinds = lambda *k: F.col("symbol_type").isin(*k)
    return s.groupBy("path").agg(
        F.lit("OK").alias("parse_status"), F.lit(None).cast("string").alias("parse_error"), F.array_sort(F.collect_list(symbol)).alias("symbols"), F.collect_list(F.when(kinds("FUNCTION", "METHOD"), call)).alias("calls"),
        F.collect_list(F.when(kinds("CLASS"), base)).alias("inherits"), F.collect_list(F.when(kinds("MODULE"), imported)).alias("imports"),
    ).withColumn("diagnostics", F.expr("cast(array() as array<struct<severity:string,code:string,message:string,line:int,recovery:string>>)"))


def model_symbols(spark, folder):
    facts = _table_facts(spark, folder)
    files = facts.select("path", ids.file_id("path").alias("id"), F.lit("x").alias("language"))
    return model.symbol_table(facts, files, F.lit("mv_0")).select("id", "file_id", "path", "qualified_name", "symbol_type", "content_hash", "parent", "ordinal", "group_size")


def model_relationships(spark, folder):
    facts = cut(_table_facts(spark, folder))
    return model.relationship_table(facts, cut(model.symbol_ids(facts)), F.lit("mv_0")).select("id", "source_symbol_id", "target_symbol_id", "relationship_type", "resolution_status", "confidence", "target_name", "path")


def model_chunks(spark, folder):
    facts = cut(_table_facts(spark, folder))
    files = facts.select("path", ids.file_id("path").alias("id"), F.lit("x").alias("language"))
    return model.chunk_table(facts, model.symbol_table(facts, files, F.lit("mv_0")), F.lit("mv_0")).select("id", "symbol_id", "chunk_type", text.hash_text("text").alias("text_hash"), "token_count")


def model_resolutions(spark, folder):
    """Targets of the table's calls: of methods by ``self``, of functions by their name."""
    facts = cut(_table_facts(spark, folder))
    calls, imports, bindings = resolve.call_facts(facts.withColumn("bindings", F.expr(f"cast(array() as {BINDINGS})")))
    return resolve.resolve_calls(calls, model.symbol_ids(facts), imports, bindings)


def _facts(spark, folder, slices=False):
    corpus = table(spark, folder, "corpus").select(F.concat_ws("/", "repo", "path").alias("path"), "content")
    return cut(parse_files(corpus, slices))


def assemble_relationships(spark, folder):
    parsed = _facts(spark, folder)
    edges = model.relationship_table(parsed, cut(model.symbol_ids(parsed).drop("slice", "documentation", "signature")), F.lit("mv_0"))
    return edges.select("id", "source_symbol_id", "target_symbol_id", "relationship_type", "resolution_status", "confidence", "target_name")


def assemble_chunks(spark, folder):
    parsed = _facts(spark, folder, True)
    files = parsed.select("path", ids.file_id("path").alias("id"), F.lit(None).cast("string").alias("language"))
    return model.chunk_table(parsed, model.symbol_table(parsed, files, F.lit("mv_0")), F.lit("mv_0")).select("id", "symbol_id", "chunk_type", "token_count")


def resolve_targets(spark, folder):
    """Every call of the corpus with the symbol it means, as far as that can be told."""
    parsed = _facts(spark, folder)
    symbols = cut(model.symbol_ids(parsed).select("id", "path", "name", "qualified_name", "symbol_type", "parent"))
    calls, imports, bindings = resolve.call_facts(parsed)
    return resolve.resolve_calls(calls, symbols, imports, bindings)


def resolve_imports(spark, folder):
    parsed = _facts(spark, folder)
    return resolve.resolve_imports(parsed.select("path", F.explode("imports.module").alias("module")), model.symbol_ids(parsed))


# graphs -----------------------------------------------------------------------------------------------------


def _places(spark, folder):
    """Orders to customers to nations to regions, as edges."""
    o, c, n = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    name = lambda kind, col: F.concat(F.lit(kind), F.col(col).cast("string"))
    one = o.select(name("o", "o_orderkey").alias("source"), name("c", "o_custkey").alias("target"))
    return one.unionByName(c.select(name("c", "c_custkey").alias("source"), name("n", "c_nationkey").alias("target"))).unionByName(n.select(name("n", "n_nationkey").alias("source"), name("r", "n_regionkey").alias("target")))


def _regions(spark, folder):
    return table(spark, folder, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))


def _containers(spark, folder):
    """Symbols to their containers, by qualified name within a file."""
    s = table(spark, folder, "code_symbols").select("id", "file_id", "qualified_name").distinct()
    up = s.withColumn("parent", F.regexp_extract("qualified_name", r"^(.*)[.:][^.:]*$", 1))
    return up.join(s.select(F.col("id").alias("target"), "file_id", F.col("qualified_name").alias("parent")), ["file_id", "parent"]).select(F.col("id").alias("source"), "target").distinct()


def graph_callers(spark, folder):
    s = table(spark, folder, "code_symbols")
    return graph.callers(_containers(spark, folder), s.where("upper(trim(symbol_type)) = 'CLASS'").select(F.col("id").alias("node")))


def graph_callees(spark, folder):
    s = table(spark, folder, "code_symbols")
    return graph.callees(_containers(spark, folder), s.where("upper(trim(symbol_type)) = 'METHOD'").select(F.col("id").alias("node")))


def graph_khop(spark, folder):
    seeds = table(spark, folder, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return graph.reachable(_places(spark, folder), seeds, 2)


def impact(spark, folder):
    return graph.impacted(_places(spark, folder), _regions(spark, folder), 3)


def _transitions(spark, folder):
    """From each event's type to the type of the same user's next event."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select(F.col("event_type").alias("source"), F.lead("event_type").over(w).alias("target")).where("target is not null and source < target or (source = 'purchase' and target = 'click')").distinct()


def graph_cycles(spark, folder):
    return graph.cyclic_nodes(_transitions(spark, folder), 5)


def graph_paths(spark, folder):
    t = cut(_transitions(spark, folder))
    nodes = t.select(F.col("source").alias("node")).distinct()
    return graph.trace_paths(t, nodes, nodes, 3).select("source", "target", F.array_join("path", ">").alias("path"), "hops")


def graph_path_evidence(spark, folder):
    """Each hop of the paths with its edge and what shows it: here the first event of the edge's kind."""
    from pyspark.sql import Window as W

    t = cut(_transitions(spark, folder))
    nodes = t.select(F.col("source").alias("node")).distinct()
    edges = t.select(F.concat_ws(">", "source", "target").alias("id"), "source", "target")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    shown = table(spark, folder, "events").select(F.concat_ws(">", "event_type", F.lead("event_type").over(w)).alias("entity_id"), F.col("event_id").cast("string").alias("evidence_id"))
    return graph.path_evidence(graph.trace_paths(t, nodes, nodes, 3), edges, shown)


# retrieval ----------------------------------------------------------------------------------------------------

NEEDLE, WORDS = "validate", ["parser", "module", "catalog"]


def symbol_search(spark, folder):
    s = table(spark, folder, "code_symbols").groupBy("id", "name", "qualified_name").agg(F.min("documentation").alias("documentation"))
    return search.search_symbols(s, NEEDLE, 50)


def bm25_topk(spark, folder):
    return search.bm25(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"), WORDS, 20)


def vector_topk(spark, folder):
    v = table(spark, folder, "embeddings")
    return search.nearest(v, v.where("vec_id % 20 = 0"), 5)


def bm25_indexed(spark, folder):
    """The same ranking from an inverted index, which is built once and kept."""
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.bm25_indexed(cut(search.inverted_index(d)), cut(search.text_sizes(d)), WORDS, 20)


def vector_index(spark, folder):
    """The nearest vectors by the index, of the same queries as ``vector_topk``; recall is tested against it."""
    v = table(spark, folder, "embeddings")
    centroids = vectors.fit(v)
    # these vectors hardly cluster: 65 % of the lists have to be probed for a recall of 0.9
    return vectors.search(cut(vectors.build(v, centroids)), centroids, v.where("vec_id % 20 = 0"), 5, -(-len(centroids) * 13 // 20))


def hybrid_context(spark, folder):
    """Context for a question about documents: full text, the vectors nearest to the first query vector (a vector's id is
    its document's), and the documents before and after in the same source as graph; 3,000 tokens of distinct texts."""
    from pyspark.sql import Window as W

    d, v = table(spark, folder, "documents"), table(spark, folder, "embeddings")
    texts = d.select(F.col("doc_id").alias("id"), "text")
    near = search.nearest(v, v.where("vec_id = 20"), 50).select(F.col("vec_id").alias("id"), "position")
    following = d.select(F.col("doc_id").alias("source"), F.lead("doc_id").over(W.partitionBy("source", F.floor(F.col("doc_id") / 4096)).orderBy("doc_id")).alias("target"))
    return retrieve.hybrid([search.bm25(texts, WORDS, 50).select("id", "position"), near], following, texts, 20, 3000)


def hybrid_rrf(spark, folder):
    """Full text, vectors and graph neighbours fused by reciprocal ranks, before any cut."""
    d, v = table(spark, folder, "documents"), table(spark, folder, "embeddings")
    near = search.nearest(v, v.where("vec_id = 20"), 50).select(F.col("vec_id").alias("id"), "position")
    words = search.bm25(d.select(F.col("doc_id").alias("id"), "text"), WORDS, 50).select("id", "position")
    edges = v.select(F.col("vec_id").alias("source"), (F.col("vec_id") + 1).alias("target"))
    return search.fuse([words, near, retrieve.expanded(search.fuse([words, near], 20), edges)], 20)


def context_budget(spark, folder):
    """Of each repository the chunks, smallest symbols first, that fit 4,000 tokens."""
    c = table(spark, folder, "semantic_chunks").select("repo", "id", (F.floor(F.length("text") / 4)).alias("tokens")).distinct()
    return search.within_budget(c, 4000, "repo", ["tokens", "id"]).select("repo", "id", F.col("position").cast("int").alias("position"), "running")


def store_lookups(spark, folder):
    """Points of the model by the lookups: the first module by name, its file, its chunks, its edges and its evidence."""
    s, c, f = (table(spark, folder, t) for t in ("code_symbols", "semantic_chunks", "file_records"))
    first = s.where("symbol_type = 'MODULE'").agg(F.min_by("qualified_name", F.struct("qualified_name", "id")).alias("q"), F.min_by("id", F.struct("qualified_name", "id")).alias("id"), F.min_by("file_id", F.struct("qualified_name", "id")).alias("f")).first()
    path = f.where(F.col("id") == first.f).agg(F.min("path").alias("p")).first().p
    edges = _containers(spark, folder).select(F.col("source").alias("source_symbol_id"), F.col("target").alias("target_symbol_id"))
    evidence = model.evidence_table(s.select("id", "file_id", "location", "model_version").distinct())
    parts = {
        "symbol": lookups.symbol_by_id(s, first.id).select("id"), "name": lookups.symbols_by_name(s, first.q).select("id").distinct(), "file": lookups.file_by_path(f, path).select(F.col("path").alias("id")),
        "from": lookups.relationships_from(edges, first.id).select(F.col("target_symbol_id").alias("id")), "to": lookups.relationships_to(edges, first.id).select(F.col("source_symbol_id").alias("id")),
        "evidence": lookups.evidence_of(evidence, first.id).select("id").distinct(), "chunk": c.where(F.col("symbol_id") == first.id).select("id").distinct(),
    }
    out = None
    for kind, df in parts.items():
        one = df.select(F.lit(kind).alias("lookup"), "id")
        out = one if out is None else out.unionByName(one)
    return out


def intents(spark, folder):
    d = table(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", answers.classify_intent(F.col("text")).alias("i")).select("doc_id", "i.intent", "i.confidence")


def answers_of_intents(spark, folder):
    """The answers about the first class by name: who is in it, what it is in, what a change of it touches, and where it is."""
    s = table(spark, folder, "code_symbols")
    name = s.where("upper(trim(symbol_type)) = 'CLASS'").agg(F.min("name").alias("n")).first().n
    edges = cut(_containers(spark, folder))
    out = None
    for intent in ("FIND_CALLERS", "FIND_CALLEES", "IMPACT", "DEFINITION"):
        one = answers.answer(intent, name, s, edges, 3).select(F.lit(intent).alias("intent"), "node", "via", "distance")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def invalidated_edges(spark, folder):
    edges = _containers(spark, folder).select(F.concat_ws(">", "source", "target").alias("id"), F.col("source").alias("source_symbol_id"), F.col("target").alias("target_symbol_id"))
    changed = table(spark, folder, "code_symbols").where("upper(trim(symbol_type)) = 'CLASS'").select("id")
    return resolve.invalidated(edges, changed)


# streams --------------------------------------------------------------------------------------------------------


def event_tumbling(spark, folder):
    return feeds.windowed(table(spark, folder, "events"), "1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def event_sliding(spark, folder):
    return feeds.windowed(table(spark, folder, "events"), "2 hours", "1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def event_session(spark, folder):
    return feeds.sessions(table(spark, folder, "events"), "30 minutes").withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


def stream_tumbling(spark, folder):
    """The tumbling windows, by the streaming engine over the same table."""
    s = feeds.windowed(feeds.replay(spark, folder, "events"), "1 hour")
    return feeds.run_to_end(s, "quarry_tumbling", "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_dedupe(spark, folder):
    s = feeds.distinct_events(feeds.replay(spark, folder, "events"), ["event_id"], "1 hour").select("event_id", "user_id")
    return feeds.run_to_end(s, "quarry_dedupe")


def stream_totals(spark, folder):
    """Each user's events and their value, by a stateful operator over the stream: the last row of each user."""
    rows = feeds.run_to_end(feeds.running_totals(feeds.event_time(feeds.replay(spark, folder, "events"))), "quarry_totals", "update")
    last = rows.groupBy("user_id").agg(F.max_by("total", "n").alias("total"), F.max("n").alias("n"))
    return last.select("user_id", "n", F.round("total", 4).alias("total"))


def stream_changes(spark, folder):
    """The change feed over all entries of the manifest, each path's latest against its earliest: what came in as new, and
    what differs."""
    entries = feeds.replay(spark, folder, "manifest_entries").where("repo is not null and path is not null").select(F.concat_ws("/", "repo", "path").alias("path"), "content_hash", "loaded_at")
    m = table(spark, folder, "manifest_entries").where("repo is not null and path is not null").select(F.concat_ws("/", "repo", "path").alias("path"), "content_hash", "loaded_at")
    known = cut(m.groupBy("path").agg(F.min_by("content_hash", F.struct("loaded_at", "content_hash")).alias("content_hash")).where("length(path) % 7 <> 0"))
    target = f"{ensure_checkpoint_dir(spark)}/quarry_changes-{uuid.uuid4().hex}"
    q = feeds.change_feed(entries, lambda: known, lambda df, n: df.write.mode("overwrite").parquet(f"{target}/batch={n}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(target).select("path", "kind", "old_path").distinct()


QUERIES = {
    f.__name__: f
    for f in (parse_outcomes, extract_symbols, extract_imports, extract_calls, extract_inherits, extract_bindings, parse_diagnostics, import_chunks, extract_declared, model_symbols, model_relationships, model_chunks, model_resolutions, assemble_relationships, assemble_chunks, resolve_targets, resolve_imports,
              graph_callers, graph_callees, graph_khop, impact, graph_cycles, graph_paths, graph_path_evidence, symbol_search, bm25_topk, bm25_indexed, vector_topk, vector_index, hybrid_rrf, hybrid_context, context_budget, store_lookups, intents, answers_of_intents, invalidated_edges,
              event_tumbling, event_sliding, event_session, stream_tumbling, stream_dedupe, stream_totals, stream_changes)
}

_CONTAINERS = r"""
with s as (select distinct id, file_id, qualified_name, regexp_extract(qualified_name, '^(.*)[.:][^.:]*$', 1) as parent from code_symbols),
e as (select distinct a.id as source, b.id as target from s a join s b on a.file_id = b.file_id and a.parent = b.qualified_name)
"""
_TRANSITIONS = """
with recursive t as (select distinct source, target from (select event_type as source, lead(event_type) over (partition by user_id order by ts, event_id) as target from events)
  where target is not null and source < target or (source = 'purchase' and target = 'click')),
"""


def _bm25(words: list[str], k: int) -> str:
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avg_len))" for i in range(len(words)))
    return f"""(select id, score, row_number() over (order by score desc, id) as position from (
  select id, round({score}, 6) as score from (
    select id, len(t) as len, {", ".join(f"len(list_filter(t, lambda x: x = '{w}')) as tf{i}" for i, w in enumerate(words))} from toks) d,
    (select count(*) as n, avg(len(t)) as avg_len, {", ".join(f"count(*) filter (list_contains(t, '{w}')) as df{i}" for i, w in enumerate(words))} from toks) g
  where greatest({", ".join(f"tf{i}" for i in range(len(words)))}) > 0 order by score desc, id limit {k}))"""


_TOKS = "with toks as (select doc_id as id, list_transform(list_filter(string_split_regex(text, '[^A-Za-z0-9_]+'), lambda x: x <> ''), lambda x: lower(x)) as t from documents where text is not null) "
_HYBRID = _TOKS + """, words as (select id, position from """ + _bm25(sorted(WORDS), 50) + """),
  p as (select v.vec_id as id, round(list_dot_product(v.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]))), 6) as score
    from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id = 20),
  near as (select id, row_number() over (order by score desc, id) as position from p qualify position <= 50),
  seeds as (select id, row_number() over (order by score desc, id) as position from (select id, round(sum(1.0 / (60 + position)), 9) as score from (from words union all from near) group by id) qualify position <= 20),
  e as ({edges}), b as (select source, target from e where target is not null union all select target, source from e where target is not null),
  n as (select b.target as id, min(s.position) as p from b join seeds s on s.id = b.source where b.target not in (select id from seeds) group by 1),
  grown as (select id, row_number() over (order by p, id) as position from n),
  fused as (select id, round(sum(1.0 / (60 + position)), 9) as score from (from words union all from near union all from grown) group by id order by score desc, id limit {k})
"""
_WINDOW = "select {start} as window_start, event_type, count(*) as n, round(sum(value), 4) as total from {source} group by all"
_NEEDLE = f"""with s as (select id, name, qualified_name, min(documentation) as documentation from code_symbols group by all),
r as (select id, name, qualified_name, case when lower(name) = '{NEEDLE}' then 1 when lower(qualified_name) = '{NEEDLE}' then 2 when starts_with(lower(name), '{NEEDLE}') then 3 when contains(lower(qualified_name), '{NEEDLE}') then 4
  when contains(lower(coalesce(documentation, '')), '{NEEDLE}') then 5 end as rung from s) """
_HITS = ", ".join(f"case when regexp_matches(lower(text), '{p}') then '{k}' end" for k, p in answers.INTENTS.items())
_LINES_OF = r"string_split_regex(content, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"
#: Imports as the source files write them, one to a line.
_IMPORTS = r"""
with f as (select repo || '/' || path as path, regexp_extract(lower(path), '[.]([a-z0-9]+)$', 1) as ext, string_split_regex(ltrim(content, chr(65279)), '\r\n|\n|\r') as lines from corpus where content is not null),
l as (select path, ext, unnest(lines) as line, generate_subscripts(lines, 1) as start_line from f),
i as (
  select path, start_line, regexp_extract(line, '^(?:import|from) ([\w.]+)', 1) as module, nullif(regexp_extract(line, '^from [\w.]+ import (\w+)', 1), '') as name from l
  where ext in ('py', 'pyi') and regexp_matches(line, '^(import [\w.]+|from [\w.]+ import \w+);?$')
  union all select path, start_line, regexp_extract(line, 'from "([^"]+)"', 1), nullif(regexp_extract(line, '^import [{] *(\w+) *[}]', 1), '') from l where ext in ('js', 'mjs', 'cjs', 'ts', 'tsx') and regexp_matches(line, '^import .*from "[^"]+";?$')
  union all select path, start_line, regexp_extract(line, '^import ([\w.]+)', 1), null from l where ext = 'java' and regexp_matches(line, '^import [\w.]+')
  union all select path, start_line, regexp_extract(line, '"([^"]+)"', 1), null from l where ext = 'go' and regexp_matches(line, '^\t"[^"\s]+"$'))
"""
_SLICES = f"""l as (select file_id, repo || '/' || path as path, {_LINES_OF} as p from corpus), lines as (select file_id, path, case when p[-1] = '' then p[:-2] else p end as lines from l)"""
_same = lambda a, b: f"length(t) - length(replace(t, '{a}', '')) = length(t) - length(replace(t, '{b}', ''))"
_id = lambda prefix, *parts: f"'{prefix}' || left(sha1(" + " || chr(31) || ".join(f"coalesce({p}::varchar, '')" for p in parts) + "), 16)"
#: The model that the facts made of the table of symbols have to give.
_MODEL = f"""with {_SLICES},
g as (select file_id as path, qualified_name as q, upper(trim(symbol_type)) as t, location as loc, min(name) as name, min(signature) as sig from code_symbols where qualified_name is not null group by all),
o as (select g.*, row_number() over (partition by g.path order by case when t = 'MODULE' then 0 else 1 end, loc.start_line, loc.start_col, loc.end_line, loc.end_col, q, t) - 1 as ordinal,
  count(*) over (partition by g.path, t, q) as group_size, coalesce(array_to_string(lines[loc.start_line:loc.end_line], chr(10)), '') as slice from g join lines on lines.file_id = g.path),
n as (select *, case when ordinal > 0 then regexp_extract(q, '^(.*)[.:][^.:]*$', 1) end as parent, {_id('sym_', 'path', 't', "case when group_size > 1 then q || '#' || left(sha1(coalesce(sig, '')), 6) else q end")} as bare from o),
m as (select *, bare || case when k > 0 then '~' || k else '' end as id from (select *, row_number() over (partition by bare order by ordinal) - 1 as k from n)),
first as (select path, q, arg_min(id, ordinal) as id from m group by path, q), module as (select path, id from m where ordinal = 0)
"""
_EDGES = _MODEL + f""", raw as (
  select 'CALLS' as type, path, q as owner, 'unresolved:call:' || x as target, x as target_name, loc from (select *, case when t = 'METHOD' then 'self.' || name else name end as x from m where t in ('FUNCTION', 'METHOD'))
  union all select 'INHERITS', path, parent, 'unresolved:type:' || name, name, loc from m where t = 'CLASS' union all select 'IMPORTS', path, null, 'unresolved:module:' || q, q, loc from m where t = 'MODULE'),
owned as (select raw.*, coalesce(f.id, module.id) as source from raw left join first f on f.path = raw.path and f.q = raw.owner join module on module.path = raw.path),
e as (select type, path, source, target, target_name, loc from owned union all
  select 'CONTAINS', m.path, m.id, f.id, m.parent, m.loc from m join first f on f.path = m.path and f.q = m.parent where m.id <> f.id)
"""
ORACLES = {
    "extract_imports": _IMPORTS + "select path, module, case when name is null then []::varchar[] else [name] end as names, null::varchar as alias, null::varchar as enclosing, start_line::int as start_line from i",
    "resolve_imports": _IMPORTS + f""", named as (select path, {_MODULE} as module from (select path from f where {_language_sql('path')} in {_list(_CODE)})),
  modules as (select module, count(*) as n, min({_id('sym_', 'path', "'MODULE'", 'module')}) as id from named group by module)
  select distinct i.path, i.module, case when n = 1 then id end as target_id, case when n is null then 'UNRESOLVED' when n = 1 then 'RESOLVED_EXACT' else 'AMBIGUOUS' end as resolution_status from i left join modules using (module)""",
    "extract_bindings": r"""
with l as (select file_id, repo, repo || '/' || path as path, unnest(lines) as line, generate_subscripts(lines, 1) as no from (select file_id, repo, path, string_split_regex(ltrim(content, chr(65279)), '\r\n|\n|\r') as lines from corpus where path like '%.py')),
h as (select *, case when regexp_matches(line, '^\s*(async )?def \w+\(.*\)') then regexp_replace(line, '^\s*(?:async )?def \w+\(', '') when regexp_matches(line, '^\s+\w+: \w+( = [^,]*)?,$') then trim(line) end as p from l),
b as (select file_id, repo, path, no, unnest(regexp_extract_all(p, '\w+: [A-Za-z_]\w*(?: = [^,()]*)?(?:[,)]|$)')) as x from h where p is not null),
s as (select distinct file_id, qualified_name, location.start_line as a, location.end_line as e from code_symbols where upper(trim(symbol_type)) in ('FUNCTION', 'METHOD'))
select b.path, regexp_extract(x, '^(\w+):', 1) as name, regexp_extract(x, '^\w+: (\w+)', 1) as type_name, 'PARAMETER' as scope, b.repo || '.' || arg_max(s.qualified_name, s.a) as enclosing, b.no::int as start_line
from b join s on s.file_id = b.file_id and b.no between s.a and s.e group by b.path, b.repo, b.no, x""",
    "import_chunks": _IMPORTS + """, c as (select path, string_agg(module || case when name is null then '' else ' (' || name || ')' end, chr(10) order by start_line) as text from i group by path)
  select f.path, coalesce(c.text, '(no imports)') as text from f left join c using (path)""",
    "extract_declared": f"""with {_SLICES}, s as (select distinct path, name, upper(trim(symbol_type)) as symbol_type, coalesce(array_to_string(lines[location.start_line:location.end_line], chr(10)), '') as t from code_symbols join lines using (file_id))
  select distinct path, name, symbol_type from s where symbol_type <> 'MODULE' and {_same('(', ')')} and {_same('[', ']')} and {_same('{', '}')}
  and (contains(t, name || '(') or contains(t, 'class ' || name) or contains(t, 'type ' || name) or contains(t, name || ' = ') or contains(t, name || '<'))""",
    "model_symbols": _MODEL + f"select id, {_id('file_', 'path')} as file_id, path, q as qualified_name, t as symbol_type, 'sha256:' || sha256(slice) as content_hash, parent, ordinal::int as ordinal, group_size from m",
    "model_relationships": _EDGES + f"""select {_id('rel_', 'source', 'type', 'target_name', 'loc.start_line', 'loc.start_col')} as id, source as source_symbol_id, target as target_symbol_id, type as relationship_type,
  case when type = 'CONTAINS' then 'RESOLVED_EXACT' else 'UNRESOLVED' end as resolution_status, case when type = 'CONTAINS' then 1.0 else 0.0 end::double as confidence, target_name, path from e""",
    "model_chunks": _MODEL + f""", c as (select id as symbol_id, slice as x, lower(t) as chunk_type from m where slice <> '' union all select id, q || ' (' || name || ')', 'imports' from m where ordinal = 0 and t = 'MODULE' union all select id, '(no imports)', 'imports' from m where ordinal = 0 and t <> 'MODULE')
  select {_id('chunk_', 'symbol_id', 'chunk_type')} as id, symbol_id, chunk_type, 'sha256:' || sha256(x) as text_hash, case when x = '' then 0 else greatest(1, length(x) // 4) end::int as token_count from c""",
    "model_resolutions": _MODEL + f""", c as (select distinct path, q as enclosing, case when t = 'METHOD' then 'self' end as receiver, name, path || ':' || loc.start_line || ':' || loc.start_col || ':' || name as call_id from m where t in ('FUNCTION', 'METHOD')),
  h as (select call_id, 2 as rung, m.id from c join m on m.parent = regexp_extract(c.enclosing, '^(.*)[.][^.:]*$', 1) and m.name = c.name where receiver = 'self'
    union select call_id, 3, b.id from c join m a on a.path = c.path and a.t = 'MODULE' and a.name = c.name join m b on regexp_extract(b.q, '^([^:]*):', 1) = a.q and b.name = c.name where receiver is null
    union select call_id, 4, m.id from c join m on m.path = c.path and m.name = c.name and m.t in ('FUNCTION', 'CLASS') where receiver is null
    union select call_id, 5, u.id from c join (select name, min(id) as id from m where t <> 'MODULE' group by name having count(distinct id) = 1) u on u.name = c.name),
  best as (select call_id, rung, count(*) as n, min(id) as id from h group by call_id, rung qualify row_number() over (partition by call_id order by rung) = 1)
  select c.call_id, case when n = 1 then best.id end as target_id, best.rung::int as rung, case when n is null then 'UNRESOLVED' when n > 1 then 'AMBIGUOUS' when best.rung <= 4 then 'RESOLVED_EXACT' else 'RESOLVED_LIKELY' end as resolution_status from c left join best using (call_id)""",
    "graph_callers": _CONTAINERS + "select source, target from e where target in (select id from code_symbols where upper(trim(symbol_type)) = 'CLASS')",
    "graph_callees": _CONTAINERS + "select source, target from e where source in (select id from code_symbols where upper(trim(symbol_type)) = 'METHOD')",
    "invalidated_edges": _CONTAINERS + ", c as (select id from code_symbols where upper(trim(symbol_type)) = 'CLASS') select source || '>' || target as id, source as source_symbol_id, target as target_symbol_id from e where source in (select id from c) or target in (select id from c)",
    "graph_khop": """select 'c' || c_custkey as seed, 'c' || c_custkey as node, 0 as distance from customer union all select 'c' || c_custkey, 'n' || c_nationkey, 1 from customer
  union all select 'c' || c_custkey, 'r' || n_regionkey, 2 from customer join nation on c_nationkey = n_nationkey""",
    "impact": """select 'r' || r_regionkey as seed, 'r' || r_regionkey as node, 0 as distance from region union all select 'r' || n_regionkey, 'n' || n_nationkey, 1 from nation
  union all select 'r' || n_regionkey, 'c' || c_custkey, 2 from customer join nation on c_nationkey = n_nationkey
  union all select distinct 'r' || n_regionkey, 'o' || o_orderkey, 3 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "graph_cycles": _TRANSITIONS + "w as (select source as seed, target as node, 1 as n from t union all select w.seed, t.target, w.n + 1 from w join t on t.source = w.node where w.n < 5) select seed as node, min(n)::int as length from w where seed = node group by seed",
    "graph_paths": _TRANSITIONS + """nodes as (select distinct source as node from t),
  w as (select node as source, node as target, [node] as p, 0 as n from nodes union all select w.source, t.target, list_append(w.p, t.target), w.n + 1 from w join t on t.source = w.target where w.n < 3)
  select source, target, array_to_string(p, '>') as path, n::int as hops from w where target in (select node from nodes) qualify row_number() over (partition by source, target order by n, p) = 1""",
    "graph_path_evidence": _TRANSITIONS + """nodes as (select distinct source as node from t),
  w as (select node as source, node as target, [node] as p, 0 as n from nodes union all select w.source, t.target, list_append(w.p, t.target), w.n + 1 from w join t on t.source = w.target where w.n < 3),
  best as (select source, target, p from w where target in (select node from nodes) qualify row_number() over (partition by source, target order by n, p) = 1),
  hops as (select source as start, target as goal, unnest(range(1, len(p))) as hop, p from best),
  shown as (select event_type || '>' || next as edge, min(event_id::varchar) as evidence_id from (select event_type, event_id, lead(event_type) over (partition by user_id order by ts, event_id) as next from events) group by 1)
  select start, goal, hop::int as hop, p[hop] as source, p[hop + 1] as target, p[hop] || '>' || p[hop + 1] as edge_id, evidence_id from hops left join shown on edge = p[hop] || '>' || p[hop + 1]""",
    "symbol_search": _NEEDLE + "select id, name, qualified_name, rung::int as rung from r where rung is not null order by rung, qualified_name, id limit 50",
    "bm25_topk": _TOKS + "select id, score, position from " + _bm25(sorted(WORDS), 20),
    "bm25_indexed": _TOKS + "select id, score, position from " + _bm25(sorted(WORDS), 20),
    "hybrid_rrf": _HYBRID.format(edges="select vec_id as source, vec_id + 1 as target from embeddings", k=20) + "select id, score, row_number() over (order by score desc, id) as position from fused",
    "hybrid_context": _HYBRID.format(edges="select doc_id as source, lead(doc_id) over (partition by source, doc_id // 4096 order by doc_id) as target from documents", k=80) + """
  , held as (select f.id, f.score, length(text) // 4 as tokens from fused f join documents on doc_id = f.id where text is not null qualify row_number() over (partition by text order by f.score desc, f.id) = 1),
  r as (select id, score, row_number() over (order by score desc, id) as position, tokens, sum(tokens) over (order by score desc, id)::bigint as running from held)
  select * from r where running <= 3000""",
    "vector_topk": """with p as (select q.vec_id as query_id, v.vec_id, round(list_dot_product(v.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]))), 6) as score
  from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 20 = 0)
  select *, row_number() over (partition by query_id order by score desc, vec_id) as position from p qualify position <= 5""",
    "context_budget": """with c as (select distinct repo, id, length(text) // 4 as tokens from semantic_chunks), r as (select *, row_number() over (partition by repo order by tokens, id) as position from c),
  s as (select *, sum(tokens) over (partition by repo order by position) as running from r) select repo, id, position, running::bigint as running from s where running <= 4000""",
    "store_lookups": _CONTAINERS + f""", x as (select qualified_name as q, id, file_id as f from code_symbols where symbol_type = 'MODULE' order by 1, 2 limit 1), y as (select min(path) as p from file_records, x where file_records.id = x.f)
  select 'symbol' as lookup, id from x union all select distinct 'name', c.id from code_symbols c, x where c.qualified_name = x.q union all select 'file', p from y
  union all select 'from', e.target from e, x where e.source = x.id union all select 'to', e.source from e, x where e.target = x.id union all select distinct 'chunk', c.id from semantic_chunks c, x where c.symbol_id = x.id
  union all select distinct 'evidence', {_id('ev_', 'c.id', 'c.file_id', 'c.location.start_line', 'c.location.end_line', "'offline.ast'")} from code_symbols c, x where c.id = x.id""",
    "intents": f"""select doc_id, case when len(h) = 0 then 'UNKNOWN' when len(h) > 2 then 'AMBIGUOUS' else h[1] end as intent, case when len(h) > 0 then round(1.0 / len(h), 6) else 0.0 end as confidence
  from (select doc_id, list_filter([{_HITS}], lambda x: x is not null) as h from documents where text is not null)""",
    "answers_of_intents": _CONTAINERS + """, n as (select distinct id from code_symbols where lower(name) = (select lower(min(name)) from code_symbols where upper(trim(symbol_type)) = 'CLASS')),
  one as (select n.id as via, e.source as node from n join e on e.target = n.id), two as (select one.via, e.source as node from one join e on e.target = one.node), three as (select two.via, e.source as node from two join e on e.target = two.node),
  far as (select via, node, min(d) as d from (select via, node, 1 as d from one union all select via, node, 2 from two union all select via, node, 3 from three) group by all)
  select 'FIND_CALLERS' as intent, node, via, 1 as distance from one union select 'FIND_CALLEES', e.target, e.source, 1 from n join e on e.source = n.id union select 'IMPACT', node, via, min(d) from far where node <> via group by node, via union select 'DEFINITION', id, id, 0 from n""",
    "event_tumbling": _WINDOW.format(start="date_trunc('hour', ts)", source="events"),
    "stream_tumbling": _WINDOW.format(start="date_trunc('hour', ts)", source="events"),
    "event_sliding": _WINDOW.format(start="w", source="(select event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as w from events)"),
    "event_session": """with g as (select user_id, ts, case when ts - lag(ts) over w >= interval 30 minutes or lag(ts) over w is null then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)),
  k as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id, min(ts) as session_start, count(*) as n from k group by user_id, s""",
    "stream_totals": "select user_id, count(*) as n, round(sum(value), 4) as total from events group by user_id",
    "stream_changes": """with m as (select distinct repo || '/' || path as path, content_hash, loaded_at from manifest_entries where repo is not null and path is not null),
  old as (select path, content_hash as h from m qualify row_number() over (partition by path order by loaded_at nulls first, content_hash nulls first) = 1), new as (select path, content_hash as h from m qualify row_number() over (partition by path order by loaded_at desc nulls last, content_hash desc nulls last) = 1)
  select n.path, case when o.path is null then 'NEW' when o.h = n.h and o.h <> '' then 'UNCHANGED' else 'CHANGED' end as kind, null::varchar as old_path from new n left join (select * from old where length(path) % 7 <> 0) o using (path)""",
    "stream_dedupe": "select distinct event_id, user_id from events",
}
