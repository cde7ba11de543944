"""Encoding of a whole corpus with a public byte-level BPE tokenizer, by reuse of shared chunks.

1. Texts are cut where a rolling hash of the last 16 bytes hits a mask, so equal passages give equal
   chunks wherever they stand.  One pass gives the references (document, position, digest); a task sends a
   chunk's text only with its first reference.
2. References meet by digest.  Each distinct chunk is encoded once, and every reference gets its ids as packed
   16-bit integers, with the chunk's head (up to the first place where white space follows a word) and its
   tail (from the last such place).  The references of a hot chunk are divided: behind every ``GROUP``
   references in a task a new group begins, which has its own place and encodes the chunk once more.
3. Each document's chunks, sorted, are streamed through a repair: tail + head around each join is encoded anew.

The repair is exact, because a pre-token never reaches over the place where white space follows a
non-space: on both sides of such a place the encoding of a text is the encoding of its parts.  A chunk
without such a place is carried on as text until one comes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.sources.tables import spread


#: Mean, smallest and largest chunk, in bytes.
MASK_BITS, LEAST, MOST = 10, 64, 8192
WINDOW = 16
_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def default_ranks() -> str:
    """Where the rank file of byte_bpe_50k lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(4)
def encoder(ranks_path: str):
    """(encode function, byte length of each id) of a rank file; kept per worker process."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coding = tiktoken.Encoding(ranks_path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    if max(ranks.values()) >= 2**16:
        raise ValueError("the vocabulary doesn't fit 16 bits")
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return coding.encode_ordinary, lengths


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of a UTF-8 text; a cut never splits a character."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    b = np.frombuffer(data, np.uint8)
    g = _GEAR[b]
    h = g.copy()
    step = 1
    while step < WINDOW:  # doubling: h covers 2 * step bytes after each round
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    hit = np.flatnonzero((h >> np.uint32(WINDOW - 1) & np.uint32((1 << MASK_BITS) - 1)) == 0) + 1
    hit = hit[(hit >= WINDOW) & (hit < n)]
    hit = hit[(b[hit] & 0xC0) != 0x80]
    ends, last = [], 0
    for e in hit.tolist():
        if e - last < LEAST:
            continue
        while e - last > MOST:
            last = _character(data, last + MOST)
            ends.append(last)
        if e > last:
            ends.append(e)
            last = e
    while n - last > MOST:
        last = _character(data, last + MOST)
        ends.append(last)
    ends.append(n)
    return ends


def _character(data: bytes, at: int) -> int:
    while data[at] & 0xC0 == 0x80:
        at -= 1
    return at


_FIRST = re.compile(r"\S(?=[ \n])")


def first_break(text: str) -> int:
    """The first place where a space or line break follows a non-space; -1 if there is none."""
    m = _FIRST.search(text)
    return m.end() if m else -1


def last_break(text: str) -> int:
    """The last such place; -1 if there is none."""
    at = max(text.rfind(" "), text.rfind("\n"))
    while at > 0:
        before = text[at - 1]
        if not before.isspace():
            return at
        if before in " \n":
            at -= 1
        else:
            at = max(text.rfind(" ", 0, at), text.rfind("\n", 0, at))
    return -1


#: References of one chunk that a task puts into one group.
GROUP = 1024
REFS = "doc_id bigint, seq int, digest binary, grp bigint, bare boolean, chunk string"


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of each document; a document that a task sees again is left out."""
    import xxhash
    from pyspark import TaskContext

    context = TaskContext.get()
    task = (context.partitionId() if context else 0) << 32
    counts: dict[bytes, int] = {}
    known: set[int] = set()
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            docs, seqs, digests, groups, texts = [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if doc in known:
                    continue
                known.add(doc)
                data = text.encode("utf-8", "replace")
                start = 0
                for k, end in enumerate(chunk_ends(data)):
                    piece = data[start:end]
                    digest = xxhash.xxh3_128_digest(piece)
                    start = end
                    n = counts.get(digest, 0)
                    counts[digest] = n + 1
                    docs.append(doc)
                    seqs.append(k)
                    digests.append(digest)
                    groups.append(n // GROUP and task + n // GROUP)
                    texts.append(None if n % GROUP else piece)
            bare = pa.array([t is None for t in texts], pa.bool_())
            columns = [pa.array(docs, pa.int64()), pa.array(seqs, pa.int32()), pa.array(digests, pa.binary()), pa.array(groups, pa.int64()), bare, pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in REFS.split(", ")])


ENCODED = "doc_id bigint, seq int, ids binary, head string, head_n int, tail string, tail_n int"


def encode_chunk(text: str, ranks_path: str) -> tuple[bytes, str, int, str, int]:
    """(ids as packed 16-bit integers, head, ids in the head, tail, ids in the tail) of one chunk.

    A chunk without a break is all head, with -1 ids in the tail.
    """
    encode, lengths = encoder(ranks_path)
    ids = np.array(encode(text), np.uint16)
    first = first_break(text)
    if first < 0:
        return ids.tobytes(), text, len(ids), "", -1
    last = last_break(text)
    head, tail = text[:first], text[last:]
    ends = np.cumsum(lengths[ids])
    head_n = int(np.searchsorted(ends, len(head.encode()))) + 1
    tail_n = len(ids) - (int(np.searchsorted(ends, int(ends[-1]) - len(tail.encode()))) + 1)
    return ids.tobytes(), head, head_n, tail, tail_n


def _encode(ranks_path: str):
    """Encodes the chunk of references that are sorted by digest, those with text first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, encoded = None, None
        types = [pa.binary(), pa.string(), pa.int32(), pa.string(), pa.int32()]
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                rows = []
                for d, text in zip(batch.column("digest").to_pylist(), batch.column("chunk").to_pylist()):
                    if d != digest:
                        digest, encoded = d, encode_chunk(text, ranks_path)
                    rows.append(encoded)
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("seq"), *(pa.array(list(c), t) for c, t in zip(cols, types))], names=[x.split()[0] for x in ENCODED.split(", ")])

    return run


class Assembly:
    """The chunks of one document, added in order, become its ids."""

    def __init__(self, encode):
        self.encode, self.parts, self.carry = encode, [], ""

    def add(self, ids: bytes, head: str, head_n: int, tail: str, tail_n: int) -> None:
        a = np.frombuffer(ids, np.uint16)
        start = 0
        if self.carry:
            if head[0] in " \n" and not self.carry[-1].isspace():
                self.flush()
            elif tail_n < 0:
                self.carry += head
                return
            else:
                self.carry += head
                self.flush()
                start = head_n
        if tail_n < 0:
            self.carry = head
            return
        self.parts.append(a[start : len(a) - tail_n])
        self.carry = tail

    def flush(self) -> None:
        self.parts.append(np.array(self.encode(self.carry), np.uint16))
        self.carry = ""

    def ids(self) -> np.ndarray:
        if self.carry:
            self.flush()
        return np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint16)


def _assemble(ranks_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = encoder(ranks_path)
        doc, seq, current = None, -1, None
        out_docs, out_ids, size = [], [], 0

        def emit():
            lengths = np.fromiter((len(x) for x in out_ids), np.int64, len(out_ids))
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            values = np.concatenate(out_ids).astype(np.int32) if out_ids else np.zeros(0, np.int32)
            return pa.RecordBatch.from_arrays([pa.array(out_docs, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["doc_id", "ids"])

        columns = ("doc_id", "seq", "ids", "head", "head_n", "tail", "tail_n")
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                for d, s, *rest in zip(*(batch.column(c).to_pylist() for c in columns)):
                    if d != doc:
                        if current is not None:
                            out_docs.append(doc)
                            out_ids.append(current.ids())
                            size += len(out_ids[-1])
                            if size > 1_000_000:
                                yield emit()
                                out_docs, out_ids, size = [], [], 0
                        doc, seq, current = d, -1, Assembly(encode)
                    if s != seq:  # a repeated row repeats its chunks
                        current.add(*rest)
                        seq = s
        if current is not None:
            out_docs.append(doc)
            out_ids.append(current.ids())
        if out_docs:
            yield emit()

    return run


def encode_documents(documents: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id, ids (list of integers) of every document; an empty and a null text give an empty list.

    Text that looks like a special token is ordinary text.  A repeated row counts once; rows of one
    doc_id with different texts are not defined (doc_id is a key).  Rows without doc_id are left out.
    """
    ranks_path = ranks_path or default_ranks()
    rows = documents.where("doc_id is not null").select("doc_id", "text")
    full = spread(rows.where("text <> ''"), "doc_id", ordered=True)
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = full.mapInArrow(_references, REFS).repartition(n, "digest", "grp").sortWithinPartitions("digest", "grp", "bare")
    ordered = met.select("doc_id", "seq", "digest", "chunk").mapInArrow(_encode(ranks_path), ENCODED).repartition(n, "doc_id").sortWithinPartitions("doc_id", "seq")
    done = ordered.mapInArrow(_assemble(ranks_path), "doc_id bigint, ids array<int>")
    empty = rows.where("text is null or text = ''").select("doc_id", F.array().cast("array<int>").alias("ids")).dropDuplicates(["doc_id"])
    return done.unionByName(empty)


def token_counts(documents: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id, tokens of every document, without keeping ids; null and empty texts have 0."""
    ranks_path = ranks_path or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = encoder(ranks_path)
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "tokens"])

    return spread(documents.where("doc_id is not null").select("doc_id", "text"), "doc_id").mapInArrow(run, "doc_id bigint, tokens bigint").dropDuplicates(["doc_id"])
