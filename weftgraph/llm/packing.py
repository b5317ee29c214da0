"""Lexical retrieval packing: a sharded BM25 index chooses what fills a seed document's window.

Document frequencies, the number of documents and their mean length are those of the whole table. Documents are placed in
shards of a bounded size (a larger one is packed in parts) by their two terms of most weight, so that those with a
rare term in common are mostly together. A shard indexes its documents (terms
are token ids) and packs them by itself, with neighbours of the shard only: a seed document opens a window; where its ids
end before the window does, the best unused neighbours by BM25, with the seed's rarest
terms as the query, follow until the window is full. What the last neighbour has left
opens the next window, with that neighbour as the seed. So every window but a shard's
last is full, and that one is cut at powers of two, which need no padding. A window that
a long document fills alone needs no query.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import storage
from weftgraph.llm import memory, shingles, tokens

WINDOW = 1024
#: Id that ends a document.
END_ID = 0
#: Documents of a shard, on average, and ids that are packed together; a part of so many is held in a task's memory.
SHARD_DOCS, PART_IDS = 1200, 4_000_000
#: Bytes of ids whose terms are counted together.
TOGETHER_BYTES = 4_000_000
#: Terms of a query, neighbours that it returns at first, and BM25's constants.
QUERY_TERMS, NEIGHBOURS = 10, 16
K1, B = 1.2, 0.75
#: Share of a large group with one first term over which documents with one second term are spread.
SPREAD = 0.25


class Statistics:
    """Number of documents, their mean length and the documents of each term."""

    def __init__(self, n: int, length: int, df: np.ndarray):
        self.n, self.mean, self.df = n, max(1.0, length / n if n else 1.0), df
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)

    def norm(self, lengths) -> np.ndarray:
        return np.asarray(K1 * (1 - B + B * lengths / self.mean)).astype(np.float32)

    def first_terms(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Each document's two terms of most weight among those that others have; -1 where there is none. Entries are by document and term; none is empty."""
        weight = np.where(self.df[term] > 1, self.idf[term] * tf * np.float32(K1 + 1) / (tf + self.norm(lengths)[doc]), 0)
        start, out = np.searchsorted(doc, np.arange(len(lengths))), []
        for _ in range(2):
            most = np.maximum.reduceat(weight, start)
            best = np.flatnonzero(weight == most[doc])
            best = best[np.searchsorted(doc[best], np.arange(len(lengths)))]  # of equal weights the least term
            out.append(np.where(most > 0, term[best], -1))
            weight[best] = 0
        return out


def counted_terms(kind: str, ids: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, its count) of documents' ids with the end id, by document and term, and the documents' lengths."""
    n, width = len(ids), np.dtype(kind).itemsize
    _, ends, data = ids.buffers()
    ends = np.frombuffer(ends, "<i4")[ids.offset : ids.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data or b"", kind, (ends[-1] - ends[0]) // width, ends[0])
    lengths = np.diff(ends) // width
    doc = np.arange(n)
    small = width == 2 and n <= 1 << 16 and end_id < 1 << 16
    whole, bits = (np.uint32, 16) if small else (np.uint64, 32)
    keys = np.concatenate([np.repeat(doc.astype(whole), lengths) << whole(bits) | flat.astype(whole), doc.astype(whole) << whole(bits) | whole(end_id)])
    keys.sort()
    first = np.flatnonzero(np.concatenate([keys[:1] == keys[:1], keys[1:] != keys[:-1]]))
    tf, keys = np.diff(first, append=len(keys)), keys[first]
    return (keys >> whole(bits)).astype(np.int64), (keys & whole((1 << bits) - 1)).astype(np.int64), tf, lengths + 1


class Index:
    """BM25 over a shard's documents, given as arrays of term ids, with the statistics of all documents (the shard's own if none are given)."""

    def __init__(self, docs: list[np.ndarray], stats: Statistics | None = None):
        self.n = n = len(docs)
        lengths = np.fromiter(map(len, docs), np.int64, n)
        flat = np.concatenate([np.zeros(0, np.uint32), *docs])
        small = n <= 1 << 16 and (not len(flat) or flat.max() < 1 << 16)
        kind, bits = (np.uint32, 16) if small else (np.uint64, 32)
        pairs = np.sort(np.repeat(np.arange(n, dtype=kind), lengths) << kind(bits) | flat.astype(kind))
        first = np.flatnonzero(np.concatenate([pairs[:1] == pairs[:1], pairs[1:] != pairs[:-1]]))
        tf = np.diff(first, append=len(pairs)).astype(np.float32)
        pairs = pairs[first]
        doc = (pairs >> kind(bits)).astype(np.int32)
        # entries by document: term and weight; a document's are at own[d] to own[d + 1]
        self.term = (pairs & kind((1 << bits) - 1)).astype(np.uint16 if small else np.uint32)
        self.own = np.searchsorted(doc, np.arange(n + 1))
        self.df = np.bincount(self.term, minlength=1)
        self.start = np.cumsum(self.df) - self.df
        stats = stats or Statistics(n, int(lengths.sum()), self.df)
        self.weight = stats.idf[self.term] * tf * np.float32(K1 + 1) / (tf + stats.norm(lengths)[doc])
        # postings by term
        order = np.argsort(self.term, kind="stable")
        self.posted, self.post_weight = doc[order], self.weight[order]

    def terms(self, seed: int) -> np.ndarray:
        """The seed's terms that others have, those of most weight first."""
        own = slice(self.own[seed], self.own[seed + 1])
        term, weight = self.term[own], np.where(self.df[self.term[own]] > 1, self.weight[own], 0)
        term, weight = term[weight > 0], weight[weight > 0]
        return term[np.lexsort((term, -weight))]

    def neighbours(self, query: np.ndarray, unused: np.ndarray, k: int) -> np.ndarray:
        """The best k unused documents that have a term of the query, best first (ties by position)."""
        score = np.zeros(self.n, np.float32)
        for t in query:
            a, b = self.start[t], self.start[t] + self.df[t]
            score[self.posted[a:b]] += self.post_weight[a:b]
        score[~unused] = 0
        found = np.flatnonzero(score)
        if len(found) > k:
            found = found[np.argpartition(-score[found], k - 1)[:k]]
        return found[np.lexsort((found, -score[found]))]


class Search:
    """A seed's unused neighbours: by its QUERY_TERMS terms of most weight, then, as these run out, by its next ones, to the last."""

    def __init__(self, index: Index, seed: int):
        self.index, self.terms, self.at, self.queue = index, index.terms(seed), 0, []

    def next(self, unused: np.ndarray) -> int:
        """The best unused neighbour; -1 if no unused document shares a term with the seed."""
        self.queue = [d for d in self.queue if unused[d]]
        while not self.queue and self.at < len(self.terms):
            self.queue = self.index.neighbours(self.terms[self.at : self.at + QUERY_TERMS], unused, NEIGHBOURS).tolist()
            if not self.queue:  # used documents stay used, so these terms are done with
                self.at += QUERY_TERMS
        return self.queue.pop(0) if self.queue else -1


def pack_shard(docs: list[np.ndarray], window: int = WINDOW, stats: Statistics | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard whose documents aren't empty."""
    n = len(docs)
    index, unused = Index(docs, stats), np.ones(n, bool)
    pieces, sequence, fill, free = [], 0, 0, 0
    seed, search = -1, None
    for _ in range(n):
        doc = -1
        if fill:
            search = search or Search(index, seed)
            doc = search.next(unused)
        if doc < 0:  # a new window without a rest, or no neighbour: the next unused document
            while not unused[free]:
                free += 1
            doc = free
        unused[doc] = False
        start, total = 0, len(docs[doc])
        if fill == 0:
            seed, search = doc, None
        while start < total:
            length = min(window - fill, total - start)
            pieces.append((doc, start, length, sequence, fill))
            start, fill = start + length, fill + length
            if fill == window:
                sequence, fill = sequence + 1, 0
                seed, search = doc, None
    return _cut_last(pieces, fill, sequence)


def _cut_last(pieces: list, fill: int, sequence: int) -> list:
    """The last window, if it isn't full, cut into sequences of powers of two."""
    if not fill:
        return pieces
    at = len(pieces)
    while at and pieces[at - 1][3] == sequence:
        at -= 1
    last, out = pieces[at:], pieces[:at]
    sizes = [1 << k for k in reversed(range(fill.bit_length())) if fill >> k & 1]
    offset = 0
    for doc, start, length, _, _ in last:
        while length:
            take = min(length, sizes[0] - offset)
            out.append((doc, start, take, sequence, offset))
            start, length, offset = start + take, length - take, offset + take
            if offset == sizes[0]:
                sizes.pop(0)
                sequence, offset = sequence + 1, 0
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, shard_docs: int = SHARD_DOCS, with_ids: bool = True) -> DataFrame:
    """Pieces of all docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (long), and ids (binary) unless they are left out.

    ids are little-endian unsigned 32-bit; ids_crc32 is their unsigned crc32. A null text
    counts as empty and gives the end id alone. The upper half of a sequence_id is its
    shard. Rows without a doc_id are packed too; repeated rows each are.
    An empty table gives no pieces.
    """
    spark = docs.sparkSession

    @memory.lean
    def encode(batches):
        enc = tokens.encoder(tokenizer)
        kind = "<u2" if len(enc.opens) <= 1 << 16 else "<u4"
        for batch in batches:
            at = 0
            for texts in shingles.slices(batch.column(1), tokens.TOGETHER):
                ids = [np.frombuffer(b, "<u4").astype(kind).tobytes() for b in enc.ids(texts.to_pylist())]
                n = len(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array([kind] * n), pa.array(ids, pa.binary()), batch.column(2).slice(at, n)], ["doc_id", "kind", "ids", "spot"])
                at += n

    def terms(kind, ids):
        return np.append(np.frombuffer(ids, kind).astype("<u4"), np.uint32(end_id))

    def together(kinds, ids):
        """Slices of documents whose terms are counted together; a tokenizer's ids are all of one kind."""
        at = 0
        for some in shingles.slices(ids, TOGETHER_BYTES):
            yield kinds[at].as_py(), some
            at += len(some)

    @memory.lean
    def count(batches):
        df, n, length = np.zeros(max(len(tokens.encoder(tokenizer).opens), end_id + 1), np.int64), 0, 0
        for batch in batches:
            for kind, ids in together(batch.column(0), batch.column(1)):
                _, term, _, lengths = counted_terms(kind, ids, end_id)
                df += np.bincount(term, minlength=len(df))
                n, length = n + len(ids), length + int(lengths.sum())
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": [-1, -2, *there.tolist()], "c": [n, length, *df[there].tolist()]})

    @memory.lean
    def key(batches):
        for batch in batches:
            at = 0
            for kind, ids in together(batch.column(1), batch.column(2)):
                one, two = (pa.array(x, pa.int32()) for x in shared.value.first_terms(*counted_terms(kind, ids, end_id)))
                yield pa.RecordBatch.from_arrays([*[c.slice(at, len(ids)) for c in batch.columns], one, two], ["doc_id", "kind", "ids", "spot", "one", "two"])
                at += len(ids)

    @memory.lean
    def pack_shards(batches):
        shard, keys, held, size, done = None, [], [], 0, 0
        for batch in batches:
            for s, k, kind, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and (s != shard or size >= PART_IDS):
                    yield from packed(rows := pack_shard(held, window, shared.value), shard, done, keys, held)
                    keys, held, size, done = [], [], 0, done + rows[-1][3] + 1
                if s != shard:
                    shard, done = s, 0
                keys.append(k)
                held.append(terms(kind, ids))
                size += len(held[-1])
        if held:
            yield from packed(pack_shard(held, window, shared.value), shard, done, keys, held)

    def packed(rows, shard, done, keys, held):
        for lo in range(0, len(rows), 4096):
            part = rows[lo : lo + 4096]
            ids = [held[d][s : s + n].tobytes() for d, s, n, _, _ in part]
            doc, start, length, sequence, offset = map(list, zip(*part))
            columns = {
                "doc_id": pa.array([keys[d] for d in doc], pa.int64()), "start": start, "length": length, "ids_crc32": [zlib.crc32(b) for b in ids],
                "doc_tokens": [len(held[d]) for d in doc], "sequence_id": [(shard << 32) + done + q for q in sequence], "offset": offset,
            }
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(ids, pa.binary())} if with_ids else {}))

    # a hash of id and text, and of where a row was read, spreads rows that have the same terms
    spot = (F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(1 << 20)) / F.lit(1 << 20)).alias("spot")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = storage.materialize(rows.select("doc_id", "text", spot).mapInArrow(encode, "doc_id long, kind string, ids binary, spot double"), "coded")
    counted = {r["term"]: r["c"] for r in coded.select("kind", "ids").mapInArrow(count, "term long, c long").groupBy("term").agg(F.sum("c").alias("c")).collect()}  # a row for each token of the tokenizer
    n, length = counted.pop(-1, 0), counted.pop(-2, 0)
    df = np.zeros(max(counted, default=0) + 1, np.int64)
    df[list(counted)] = list(counted.values())
    shared = spark.sparkContext.broadcast(Statistics(n, length, df))
    keyed = storage.materialize(coded.mapInArrow(key, "doc_id long, kind string, ids binary, spot double, one int, two int"), "keyed")
    # groups with one first term lie end to end; in a group, documents with one second term lie close together
    sizes = sorted(keyed.groupBy("one").agg(F.count("*").alias("n")).collect())  # a row for each token at most
    starts, at = [], 0
    for r in sizes:
        starts.append((r["one"], at, r["n"]))
        at += r["n"]
    groups = F.broadcast(spark.createDataFrame(starts, "one int, at long, n long"))
    second = F.pmod(F.xxhash64("two"), F.lit(1 << 20)) / F.lit(1 << 20)
    shard = F.floor((F.col("at") + F.col("n") * (second * F.lit(1 - SPREAD) + F.col("spot") * F.lit(SPREAD))) / F.lit(shard_docs)).cast("int").alias("shard")
    placed = keyed.join(groups, "one").select(shard, "doc_id", "kind", "ids")
    grouped = placed.repartition("shard").sortWithinPartitions("shard", "doc_id", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return grouped.mapInArrow(pack_shards, schema)


def op1_pack(spark, sf_dir: str) -> DataFrame:
    """All documents packed; the pieces' ids are left out of the digest."""
    return pack(storage.table(spark, sf_dir, "documents"), tokens.tokenizer_path(), with_ids=False)


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of docs, with their ids."""
    return pack(docs, tokens.tokenizer_path())
