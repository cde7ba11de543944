"""Retrieval: symbol search, full text with BM25, vectors, their fusion, and the token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.sources.tables import cut, spread

K1, B = 1.2, 0.75


def search_symbols(symbols: DataFrame, needle: str, k: int) -> DataFrame:
    """id, name, qualified_name, rung of the best ``k`` symbols: 1 exact name, 2 exact qualified name,
    3 prefix of the name, 4 part of the qualified name, 5 part of the documentation.  Ties go by qualified
    name and id.  A top-k: no global sort."""
    low = needle.lower()
    name, qualified = F.lower("name"), F.lower("qualified_name")
    rung = F.when(name == low, 1).when(qualified == low, 2).when(name.startswith(low), 3).when(F.contains(qualified, F.lit(low)), 4).when(F.contains(F.lower(F.coalesce("documentation", F.lit(""))), F.lit(low)), 5)
    hits = symbols.select("id", "name", "qualified_name", rung.alias("rung")).where("rung is not null").distinct()
    return hits.orderBy("rung", "qualified_name", "id").limit(k)


def tokens(text: Column) -> Column:
    """The runs of ASCII letters, digits and ``_``, in lower case."""
    return F.transform(F.filter(F.split(text, r"[^A-Za-z0-9_]+"), lambda t: t != ""), F.lower)


def inverted_index(texts: DataFrame) -> DataFrame:
    """token, id, tf of texts (id, text)."""
    return texts.where("id is not null").select("id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("token", "id").agg(F.count("*").alias("tf"))


def text_sizes(texts: DataFrame) -> DataFrame:
    """id, len of every text: its number of tokens."""
    return texts.where("text is not null").select("id", F.size(tokens(F.col("text"))).alias("len"))


def bm25_indexed(postings: DataFrame, sizes: DataFrame, query: list[str], k: int) -> DataFrame:
    """As ``bm25``, from an ``inverted_index`` and ``text_sizes`` that are kept: a query reads the postings of its words
    (a pushed filter) and the texts' sizes, no text.  Keep the postings clustered by token."""
    words = sorted({q.lower() for q in query})
    some = postings.where(F.col("token").isin(words))
    stats = sizes.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    df = some.groupBy("token").agg(F.count("*").alias("df"))  # a row for each word of the query
    hits = some.join(F.broadcast(df), "token").join(sizes, "id").crossJoin(F.broadcast(stats))  # one row
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    best = hits.groupBy("id").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("position", F.row_number().over(W.orderBy(F.desc("score"), "id")))


def bm25(texts: DataFrame, query: list[str], k: int) -> DataFrame:
    """id, score, position of the ``k`` best texts for the query's tokens; score rounded to 6 places.

    Nothing is exploded: lengths and occurrences are counted by patterns in one pass, and the corpus
    statistics are one row.  Query words are runs of ASCII letters, digits and ``_``.
    """
    words = sorted({q.lower() for q in query})
    inside = "[A-Za-z0-9_]"
    t = spread(texts.where("text is not null").select("id", "text"), "id")
    sized = t.select("id", F.regexp_count("text", F.lit(f"{inside}+")).alias("len"), *(F.regexp_count("text", F.lit(f"(?i)(?<!{inside}){w}(?!{inside})")).alias(f"tf{i}") for i, w in enumerate(words)))
    stats = sized.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))))
    hits = sized.where(F.greatest(F.lit(0), *(F.col(f"tf{i}") for i in range(len(words)))) > 0).crossJoin(F.broadcast(stats))  # one row
    score = sum((F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("len") / F.col("avg_len"))) for i in range(len(words))), F.lit(0.0))
    best = hits.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("position", F.row_number().over(W.orderBy(F.desc("score"), "id")))


def dot(a: Column, b: Column) -> Column:
    """The dot product of two arrays of equal length, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a norm is 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def spread_factor(rows: DataFrame) -> int:
    """Into how many parts the vectors of one block of queries are divided: one for each core."""
    return rows.sparkSession.sparkContext.defaultParallelism


def nearest(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """query_id, vec_id, score, position: the ``k`` nearest vectors of each query vector by cosine, never
    itself; scores rounded to 6 places, ties by vec_id.

    ``where`` says which vectors may be answers, by their metadata or model version.

    The stated query set is held in blocks of about 256 against all vectors: each block of queries is an
    array in one row, so a vector meets a block in one row and emits only its pairs.  The vectors of a block are salted,
    and each group of vectors keeps its best k per query before the final ranking.  This is exact and costs every pair of
    query and vector; ``vectors.search`` over an index is for query sets that grow with the table.
    """
    n_blocks = max(1, -(-queries.count() // 256))
    salts = spread_factor(vectors)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))
    blocks = queries.select(block.alias("block"), F.struct(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), norm(F.col("embedding")).alias("size")).alias("q")).groupBy("block").agg(F.collect_list("q").alias("qs")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    usable = (vectors if where is None else vectors.where(where)).where("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    copies = spread(usable, "vec_id").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int")).select("vec_id", "salt", "embedding", norm(F.col("embedding")).alias("size"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))).alias("block"))
    pairs = copies.join(blocks, ["block", "salt"]).select("vec_id", "embedding", "size", F.explode("qs").alias("q")).where("vec_id <> q.query_id")
    scored = pairs.select(F.col("q.query_id").alias("query_id"), "vec_id", F.round(F.try_divide(dot(F.col("embedding"), F.col("q.query")), F.col("size") * F.col("q.size")), 6).alias("score"))
    part = W.partitionBy("query_id", F.pmod("vec_id", F.lit(16))).orderBy(F.desc("score"), "vec_id")
    some = scored.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k).drop("r")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return some.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def fuse(rankings: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """id, score, position: reciprocal rank fusion of rankings (id, position), the ``k`` best."""
    every = rankings[0].select("id", "position")
    for r in rankings[1:]:
        every = every.unionByName(r.select("id", "position"))
    fused = every.groupBy("id").agg(F.round(F.sum(1.0 / (constant + F.col("position"))), 9).alias("score"))
    best = fused.orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("position", F.row_number().over(W.orderBy(F.desc("score"), "id")))


def running(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``position`` and ``running``: the number and the sum of ``value`` up to each row of its group, in
    ``order`` (columns that leave no ties).

    Prefix sums in two levels: the rows are sorted in ranges of (group, order), each range sums up on its own, and the
    few sums of the ranges before are added.  A group that holds a third of all rows lies in many ranges.
    """
    ranged = rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id())
    ranged = cut(ranged)  # a row's range has to stay what it is
    own = W.partitionBy("_range", group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = ranged.withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_sum", F.sum(value).over(own))
    sums = ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_rows"), F.sum(value).alias("_total"))
    before = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(F.col(group).alias("_group"), F.col("_range").alias("_r"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_total"))
    joined = local.join(offsets, (F.col(group).eqNullSafe(F.col("_group"))) & (F.col("_range") == F.col("_r")))
    return joined.withColumn("position", F.col("_n") + F.col("_rows")).withColumn("running", F.coalesce("_sum", F.lit(0)) + F.col("_total")).select(*rows.columns, "position", "running")


def within_budget(rows: DataFrame, budget: int, group: str, order: list[str], value: str = "tokens") -> DataFrame:
    """``rows``, in ``order``, whose running sum of ``value`` per group stays within ``budget``; with position and running."""
    return running(rows, group, order, value).where(F.col("running") <= budget)
