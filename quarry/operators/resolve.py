"""Resolution of imports and call targets: a ladder of joins; the first rung with a candidate decides.

Rungs for a call ``receiver.callee`` or ``callee``: a binding of the receiver in scope (an instance
attribute may come from an annotated parameter, one hop), a member of the enclosing class, an imported
name, a declaration of the same module, a unique name in the whole model.  Several candidates on the
deciding rung make the target AMBIGUOUS, none on any leaves it UNRESOLVED.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def decide(candidates: DataFrame, key: str, rung: str = "rung", target: str = "target_id") -> DataFrame:
    """key, target_id, rung, resolution_status of the lowest rung with candidates."""
    distinct = candidates.select(key, rung, target).distinct()
    per = distinct.groupBy(key, rung).agg(F.count("*").alias("n"), F.min(target).alias("target_id"))
    best = per.groupBy(key).agg(F.min_by(F.struct("n", "target_id", F.col(rung).alias("rung")), F.col(rung)).alias("b"))
    one = F.col("b.n") == 1
    return best.select(key, F.when(one, F.col("b.target_id")).alias("target_id"), F.col("b.rung").alias("rung"), F.when(~one, "AMBIGUOUS").when(F.col("b.rung") <= 4, "RESOLVED_EXACT").otherwise("RESOLVED_LIKELY").alias("resolution_status"))


def resolve_imports(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, module, target_id, resolution_status of import rows (path, module): modules by their dotted name."""
    modules = symbols.where("symbol_type = 'MODULE'").groupBy(F.col("qualified_name").alias("module")).agg(F.countDistinct("id").alias("n"), F.min("id").alias("target_id"))
    found = imports.select("path", "module").distinct().join(modules, "module", "left")
    return found.select("path", "module", F.when(F.col("n") == 1, F.col("target_id")).alias("target_id"), F.when(F.col("n").isNull(), "UNRESOLVED").when(F.col("n") == 1, "RESOLVED_EXACT").otherwise("AMBIGUOUS").alias("resolution_status"))


def call_facts(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, imports, bindings) of parsed files, as ``resolve_calls`` takes them."""
    at = F.concat_ws(":", "path", F.col("c.span.start_line").cast("string"), F.col("c.span.start_col").cast("string"), "c.callee")
    calls = parsed.select("path", F.explode("calls").alias("c")).select("path", "c.enclosing", "c.receiver", "c.callee", at.alias("call_id"))
    imports = parsed.select("path", F.explode("imports").alias("i")).select("path", "i.module", F.explode("i.names").alias("name"))
    bindings = parsed.select("path", F.explode("bindings").alias("b")).select("path", "b.enclosing", "b.name", "b.type_name", "b.scope")
    return calls, imports, bindings


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame, bindings: DataFrame) -> DataFrame:
    """call_id, target_id, rung, resolution_status.

    ``calls``: call_id, path, enclosing, receiver, callee; ``symbols``: id, path, name, qualified_name,
    symbol_type, parent; ``imports``: path, module, name; ``bindings``: path, enclosing, name, type_name,
    scope.  Every call has a row.
    """
    s = symbols.select(F.col("id").alias("target_id"), F.col("path").alias("s_path"), "name", "qualified_name", "symbol_type", "parent")
    classes = s.where("symbol_type in ('CLASS', 'INTERFACE', 'ENUM')").select(F.col("qualified_name").alias("class_name"), F.col("name").alias("type_name"), F.col("s_path").alias("class_path"))
    members = s.select(F.col("parent").alias("class_name"), F.col("name").alias("callee"), "target_id")
    owner = F.regexp_extract("enclosing", r"^(.*)\.[^.:]*$", 1)
    c = calls.withColumn("owner", owner).withColumn("attribute", F.regexp_extract("receiver", r"^(?:self|this|cls)\.(\w+)$", 1))

    # the type of the receiver: a local or parameter of the function, or an attribute of the instance
    attribute = bindings.where("scope = 'INSTANCE'").select(F.col("path").alias("b_path"), F.regexp_extract("enclosing", r"^(.*)\.[^.:]*$", 1).alias("owner"), F.col("enclosing").alias("b_enclosing"), F.col("name").alias("attribute"), "type_name")
    parameter = bindings.where("scope = 'PARAMETER'").select(F.col("enclosing").alias("b_enclosing"), F.col("name").alias("type_name"), F.col("type_name").alias("real_type"))
    attribute = attribute.join(parameter, ["b_enclosing", "type_name"], "left").select("b_path", "owner", "attribute", F.coalesce("real_type", "type_name").alias("type_name"))
    local = bindings.where("scope <> 'INSTANCE'").select(F.col("path").alias("b_path"), "enclosing", F.col("name").alias("receiver"), "type_name")
    typed = c.join(attribute.withColumnRenamed("b_path", "path"), ["path", "owner", "attribute"]).select("call_id", "path", "callee", "type_name").unionByName(c.join(local.withColumnRenamed("b_path", "path"), ["path", "enclosing", "receiver"]).select("call_id", "path", "callee", "type_name"))
    # the class of a type's name: of the same file, else imported by that name, else the only one of the model; a
    # frequent name is never held against all its classes
    typed = typed.distinct()
    home = typed.join(classes.select("class_name", "type_name", F.col("class_path").alias("path")), ["path", "type_name"]).withColumn("near", F.lit(1))
    named = classes.select("class_name", "type_name", F.regexp_extract("class_name", r"^([^:]*):", 1).alias("module"))
    away = typed.join(imports.select("path", "module", F.col("name").alias("type_name")).distinct(), ["path", "type_name"]).join(named, ["module", "type_name"]).withColumn("near", F.lit(2))
    only = classes.groupBy("type_name").agg(F.count("*").alias("n"), F.min("class_name").alias("class_name")).where("n = 1").drop("n")
    else_ = typed.join(only, "type_name").withColumn("near", F.lit(3))
    columns = ["call_id", "callee", "class_name", "near"]
    of_class = home.select(*columns).unionByName(away.select(*columns)).unionByName(else_.select(*columns)).distinct()
    nearest = of_class.groupBy("call_id").agg(F.min("near").alias("near"))
    by_binding = of_class.join(nearest, ["call_id", "near"]).join(members, ["class_name", "callee"]).select("call_id", F.lit(1).alias("rung"), "target_id")

    own = c.where("receiver in ('self', 'this', 'cls')").join(members.withColumnRenamed("class_name", "owner"), ["owner", "callee"]).select("call_id", F.lit(2).alias("rung"), "target_id")
    bare = c.where("receiver is null")
    by_import = bare.join(imports.select("path", "module", F.col("name").alias("callee")), ["path", "callee"]).join(s.select(F.concat(F.regexp_extract("qualified_name", r"^([^:]*):", 1)).alias("module"), F.col("name").alias("callee"), "target_id"), ["module", "callee"]).select("call_id", F.lit(3).alias("rung"), "target_id")
    same = bare.join(s.where("symbol_type in ('FUNCTION', 'CLASS')").select(F.col("s_path").alias("path"), F.col("name").alias("callee"), "target_id"), ["path", "callee"]).select("call_id", F.lit(4).alias("rung"), "target_id")
    # a name that the model has once; a frequent name is ambiguous, and doesn't multiply the calls
    once = s.where("symbol_type <> 'MODULE'").groupBy(F.col("name").alias("callee")).agg(F.countDistinct("target_id").alias("n"), F.min("target_id").alias("target_id")).where("n = 1")
    anywhere = c.join(once.select("callee", "target_id"), "callee").select("call_id", F.lit(5).alias("rung"), "target_id")
    found = decide(by_binding.unionByName(own).unionByName(by_import).unionByName(same).unionByName(anywhere), "call_id")
    return calls.select("call_id").join(found, "call_id", "left").select("call_id", "target_id", "rung", F.coalesce("resolution_status", F.lit("UNRESOLVED")).alias("resolution_status"))


def invalidated(edges: DataFrame, changed_symbols: DataFrame) -> DataFrame:
    """The relationships to resolve anew: those from or to a changed symbol (id)."""
    ids_ = changed_symbols.select("id").distinct()
    left = edges.join(ids_.withColumnRenamed("id", "source_symbol_id"), "source_symbol_id", "left_semi")
    right = edges.join(ids_.withColumnRenamed("id", "target_symbol_id"), "target_symbol_id", "left_semi")
    return left.select(*edges.columns).unionByName(right.select(*edges.columns)).dropDuplicates(["id"])


def calls_to_resolve(calls: DataFrame, bindings: DataFrame, resolved: DataFrame, parsed_paths: DataFrame, touched: DataFrame) -> DataFrame:
    """call_id of the calls whose target may have changed: those in parsed files, those whose callee or whose file's
    bindings name a touched symbol, and those that meant one.

    ``touched``: id, name of the symbols that files had or have that were parsed or are gone; ``resolved``: call_id,
    target_id of the run before."""
    names = touched.select("name").distinct()
    paths = parsed_paths.select("path").unionByName(bindings.join(names.withColumnRenamed("name", "type_name"), "type_name", "left_semi").select("path")).distinct()
    by_path = calls.join(paths, "path", "left_semi").select("call_id")
    by_name = calls.join(names.withColumnRenamed("name", "callee"), "callee", "left_semi").select("call_id")
    edges = resolved.where("target_id is not null").select(F.col("call_id").alias("id"), F.col("call_id").alias("source_symbol_id"), F.col("target_id").alias("target_symbol_id"))
    return by_path.unionByName(by_name).unionByName(invalidated(edges, touched).select(F.col("id").alias("call_id"))).distinct()
