"""Queries of this subpackage for ``__spark_entry__``."""

from pyspark.sql import functions as F

from quarry.llm import docpairs, handwritten, mojibake, neardup, packing, parse_validity, splitting, tokenize
from quarry.sources.tables import table


def p4_found(spark, folder):
    return parse_validity.invalid_files(table(spark, folder, "corpus"), table(spark, folder, "language_registry"))


def p4_parse_status(spark, folder):
    rows = parse_validity.parse_files(table(spark, folder, "corpus"), table(spark, folder, "language_registry"))
    return rows.select("file_id", "repo", "path", "language", "parse_status", "parse_error", "fault_line", "fault_count", "faults")


def p4_rates(spark, folder):
    return parse_validity.parse_rates(table(spark, folder, "corpus"), table(spark, folder, "language_registry"))


QUERIES = {"p4_found": p4_found, "p4_parse_status": p4_parse_status, "p4_rates": p4_rates}
ORACLES: dict[str, str] = {}


def p9_restored(spark, folder):
    return mojibake.garbled_documents(table(spark, folder, "documents")).distinct()


def p9_found(spark, folder):
    return mojibake.garbled_documents(table(spark, folder, "documents")).select("doc_id").distinct()


QUERIES |= {"p9_found": p9_found, "p9_restored": p9_restored}


def p2_pieces(spark, folder):
    return splitting.oversized_pieces(table(spark, folder, "semantic_chunks")).dropDuplicates(["chunk_id", "source_hash", "piece_no"])


def p2_found(spark, folder):
    return splitting.oversized_pieces(table(spark, folder, "semantic_chunks")).select("chunk_id").distinct()


def p2_rejoined(spark, folder):
    """Each oversized chunk put together again from its pieces without their overlaps; within_limit and repeats_end say
    that no piece is too large, and that each piece but the first begins with the end of the one before."""
    p = p2_pieces(spark, folder)
    pieces = F.array_sort(F.collect_list(F.struct("piece_no", "text", "overlap_chars")))
    rows = p.groupBy("chunk_id", "source_hash").agg(pieces.alias("pieces"))  # a chunk's own pieces
    fresh = F.array_join(F.transform("pieces", lambda x: F.substr(x["text"], x["overlap_chars"] + 1)), "")
    shared = F.transform(F.sequence(F.lit(1), F.size("pieces") - 1), lambda i: F.get("pieces", i)["text"].startswith(F.right(F.get("pieces", i - 1)["text"], F.lit(splitting.OVERLAP_TOKENS * splitting.CHARS_PER_TOKEN))))
    return rows.select("chunk_id", F.sha2(fresh, 256).alias("text_hash"), F.length(fresh).alias("chars"), F.forall("pieces", lambda x: F.floor(F.length(x["text"]) / 4) <= splitting.LIMIT_TOKENS).alias("within_limit"), F.forall(shared, lambda x: x).alias("repeats_end"))


QUERIES |= {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_rejoined": p2_rejoined}
ORACLES["p2_rejoined"] = "select distinct id as chunk_id, sha256(text) as text_hash, length(text)::int as chars, true as within_limit, true as repeats_end from semantic_chunks where length(text) // 4 > 512"
ORACLES["p2_found"] = "select distinct id as chunk_id from semantic_chunks where length(text) // 4 > 512"


def p7_ids(spark, folder):
    return tokenize.encode_documents(table(spark, folder, "documents"))


def p8_containers(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"))


def p8_fill(spark, folder):
    """How many containers there are, and the share of their space that is used."""
    fill = packing.container_fill(packing.pack_documents(table(spark, folder, "documents")))
    return fill.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count("*") * packing.CAPACITY), 4).alias("share_used"))


def p8_documents(spark, folder):
    """Of each document whether its tokens are placed completely, once and in order, and whether it is whole unless it is
    larger than a container."""
    p = packing.pack_documents(table(spark, folder, "documents"))
    steps = F.array_sort(F.collect_list(F.struct("from_token", "to_token")))
    d = p.groupBy("doc_id").agg(steps.alias("s"))  # a document's own pieces
    joined = F.forall(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.get("s", i)["from_token"] == F.when(i == 0, 0).otherwise(F.get("s", i - 1)["to_token"]))
    return d.select("doc_id", joined.alias("complete"), ((F.size("s") == 1) | (F.element_at("s", -1)["to_token"] > packing.CAPACITY)).alias("whole"))


def p8_free(spark, folder):
    """One row: containers that are too full, and places that two tokens share."""
    from pyspark.sql import Window as W

    p = packing.pack_documents(table(spark, folder, "documents"))
    w = W.partitionBy("container_id").orderBy("at_token")
    size = F.col("to_token") - F.col("from_token")
    ends = p.withColumn("last", F.lag(F.col("at_token") + size).over(w))
    return ends.agg(F.count_if(F.col("at_token") + size > packing.CAPACITY).alias("too_full"), F.count_if(F.col("at_token") < F.col("last")).alias("shared"))


QUERIES |= {"p7_ids": p7_ids, "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_documents": p8_documents, "p8_free": p8_free}
ORACLES["p8_documents"] = "select distinct doc_id, true as complete, true as whole from documents where text <> ''"
ORACLES["p8_free"] = "select 0::bigint as too_full, 0::bigint as shared"


def p6_found(spark, folder):
    return neardup.similar_pairs(neardup.function_texts(table(spark, folder, "semantic_chunks")))


def p6_groups(spark, folder):
    texts = neardup.function_texts(table(spark, folder, "semantic_chunks"))
    hashes = texts.select("id", "symbol_id").join(table(spark, folder, "code_symbols").select(F.col("id").alias("symbol_id"), "content_hash"), "symbol_id").select("id", "content_hash")
    return neardup.similar_groups(texts, hashes)


QUERIES |= {"p6_found": p6_found, "p6_groups": p6_groups}
_SETS_SQL = """
with texts as (
  select distinct id, regexp_extract_all(lower(text), '[a-z0-9_]+') as t from semantic_chunks
  where chunk_type in ('function', 'method')),
sets as (
  select id, unnest(list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) as s
  from texts where len(t) >= 30),
sizes as (select id, count(*) as n from sets group by id),
shared as (select a.id as a, b.id as b, count(*) as k from sets a join sets b on a.s = b.s and a.id < b.id group by a.id, b.id)
"""
ORACLES["p6_found"] = _SETS_SQL + """select a as chunk_id_a, b as chunk_id_b from shared join sizes x on x.id = a join sizes y on y.id = b
where k * 10 >= 7 * (x.n + y.n - k)"""

ORACLES["p6_groups"] = "with recursive " + _SETS_SQL.strip().removeprefix("with ") + """,
h as (select distinct c.id, s.content_hash as d from semantic_chunks c join code_symbols s on s.id = c.symbol_id where c.chunk_type in ('function', 'method') and s.content_hash <> ''),
one as (select a, b from shared join sizes x on x.id = a join sizes y on y.id = b where k * 10 >= 7 * (x.n + y.n - k) union select x.id, y.id from h x join h y on x.d = y.d and x.id < y.id),
e as (select a, b from one union select b, a from one),
reach as (select a as id, a as c from e union select e.b, reach.c from reach join e on e.a = reach.id),
classes as (select id, min(c) as class_id from reach group by id)
select id, class_id, count(*) over (partition by class_id) as class_size from classes"""


def p1_found(spark, folder):
    return handwritten.generated_files(table(spark, folder, "file_records"), table(spark, folder, "corpus"))


def p1_files(spark, folder):
    """What each file of the corpus is, beside what its record and the ledger of earlier scans say."""
    files = handwritten.classify_files(table(spark, folder, "corpus"))
    recorded = table(spark, folder, "file_records").groupBy(F.col("id").alias("file_id")).agg(F.max_by("is_generated", F.struct("scanned_at", "is_generated")).alias("recorded"))
    ledger = table(spark, folder, "excluded_files").groupBy("repo", "path").agg(F.min(F.upper("reason")).alias("ledger_reason"))
    return files.select("file_id", "repo", "path", "is_generated", "kind", "evidence", "line_count", "max_line").join(recorded, "file_id", "left").join(ledger, ["repo", "path"], "left")


def p1_method(spark, folder):
    """The layout statistics of every file and what they alone decide: paths and notices, which most cases
    show, are no layout."""
    return handwritten.layout_statistics(table(spark, folder, "corpus"))


QUERIES |= {"p1_method": p1_method, "p1_found": p1_found, "p1_files": p1_files}


def p5_pairs(spark, folder):
    return docpairs.function_pairs(table(spark, folder, "code_symbols"), table(spark, folder, "corpus"))


def p5_found(spark, folder):
    return p5_pairs(spark, folder).select("symbol_id")


QUERIES |= {"p5_found": p5_found, "p5_pairs": p5_pairs}
