"""Token-id output: flat unsigned integer files with 64-bit document offsets.

Layout of a part: ``part-NNNNN.bin`` has the ids of its documents one after the other,
``part-NNNNN.idx`` has n + 1 little-endian int64 offsets (in ids) into it, and
``part-NNNNN.doc`` has the n document ids (int64, the rows without an id first).
Parts are in ascending doc_id order; a part's base, the number of ids in all parts before
it, is the prefix sum over the manifest.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import storage
from weftgraph.llm import memory, shingles, store, tokens

#: Id that ends a document.
END_ID = 2


def id_dtype(vocab_size: int) -> str:
    """The narrowest unsigned type that holds every id."""
    return "<u2" if vocab_size <= 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encodes docs (doc_id, text) into files in folder; returns the manifest, a row for each part.

    Columns: part int, dtype string, n_docs, n_null, n_tokens, base (long). A null text
    counts as empty and gives the end id alone. Rows without a doc_id come first. Repeated
    rows are written each time, ties in the order of a hash of their texts; ranges are cut
    between rows of one doc_id too, so no id is bound to one task. Other columns are not
    read. An empty table gives an empty manifest.
    """
    folder = store.qualified(docs.sparkSession, folder)

    @memory.lean
    def write(batches):
        from pyspark import TaskContext

        enc = tokens.encoder(tokenizer)
        kind = id_dtype(len(enc.opens))
        part = TaskContext.get().partitionId()
        ids, nulls, lengths = [], 0, [np.zeros(1, "<i8")]
        end = np.array([end_id], "<u4").tobytes()

        def fill(f):
            nonlocal nulls
            for batch in batches:
                keys = batch.column(0)
                nulls += keys.null_count
                ids.append(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                for texts in shingles.slices(batch.column(1), tokens.TOGETHER):
                    got = enc.ids(texts.to_pylist())
                    lengths.append(np.fromiter((len(b) // 4 + 1 for b in got), "<i8", len(got)))
                    for b in got:
                        f.write(np.frombuffer(b + end, "<u4").astype(kind).tobytes())

        name = f"{folder}/part-{part:05d}"
        store.put(f"{name}.bin", fill)
        if not ids:
            return
        offsets = np.cumsum(np.concatenate(lengths))
        store.put(f"{name}.idx", lambda f: f.write(offsets.astype("<i8").tobytes()))
        store.put(f"{name}.doc", lambda f: f.write(np.concatenate(ids).tobytes()))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "dtype": [kind], "n_docs": [len(offsets) - 1], "n_null": [nulls], "n_tokens": [int(offsets[-1])]})

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.spark_partition_id().alias("from"))
    parts = rows.repartitionByRange("doc_id", "tie", "from").sortWithinPartitions("doc_id", "tie", "from").mapInArrow(write, "part int, dtype string, n_docs long, n_null long, n_tokens long")
    made = storage.materialize(parts, "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return made.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read_token_files(manifest: DataFrame, folder: str, block: int = 4096) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (long); a task for each file.

    ids_crc32 is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    folder = store.qualified(manifest.sparkSession, folder)

    def read(batches):
        for batch in batches:
            for m in batch.to_pylist():
                name = f"{folder}/part-{m['part']:05d}"
                ids, offsets, keys = store.array(f"{name}.bin", m["dtype"]), store.array(f"{name}.idx", "<i8"), store.array(f"{name}.doc", "<i8")
                for lo in range(0, m["n_docs"], block):
                    at = np.asarray(offsets[lo : lo + block + 1])
                    crcs = np.fromiter((zlib.crc32(np.asarray(ids[a:b]).astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:])), "<i8", len(at) - 1)
                    no_id = np.arange(lo, lo + len(at) - 1) < m["n_null"]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(np.asarray(keys[lo : lo + len(at) - 1]), mask=no_id), "start": m["base"] + at[:-1], "n_tokens": np.diff(at), "ids_crc32": crcs})

    rows = manifest.select("part", "dtype", "n_docs", "n_null", "base")
    spread = rows.repartition(max(1, rows.count()))  # a number that is given is kept; without one all files would go to one task
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents encoded into files and read back: doc_id, start, n_tokens, ids_crc32."""
    folder = storage.new_path(spark, "token-files")
    manifest = write_token_files(storage.table(spark, sf_dir, "documents"), folder, tokens.tokenizer_path())
    return read_token_files(manifest, folder)
