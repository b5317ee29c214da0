"""Size-tiered compaction of arriving documents into versioned shards.

An arrival is appended as small immutable shards: parquet files of all its columns that
its tasks write next to each other, none of them ever changed. Compaction looks at the manifest alone: files
of about one size (a tier is a power of FANOUT of their bytes) are merged, in the order of
their names, into files of the target size as soon as a tier holds FANOUT of them. Each
version is a manifest, a list of columns and files, that is written under a temporary name and put in
its place by one rename that fails if the version exists; readers take the last version,
so they see all of a change or nothing.
"""

from __future__ import annotations

import json
import os
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from weftgraph import storage
from weftgraph.llm import names, store

#: Bytes of the files that merges aim at, of the smallest tier, and the files of a tier that make a merge.
TARGET_BYTES, LEAST_BYTES, FANOUT = 64_000_000, 64_000, 4
#: Bytes of texts of a small shard.
ARRIVAL_BYTES = 4_000_000


class Conflict(RuntimeError):
    """Another writer has committed this version."""


def versions(folder: str) -> list[int]:
    """The committed versions, in order."""
    path = store.local_path(folder)
    if path is None:
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(folder)
        names = [os.path.basename(f.path) for f in where.get_file_info(fs.FileSelector(path, allow_not_found=True))]
    else:
        names = os.listdir(path) if os.path.isdir(path) else []
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def manifest(folder: str, version: int | None = None) -> dict:
    """A version's manifest, the last one by default: version, fields (columns, as in a schema's JSON) and files (name, rows, bytes)."""
    if version is None:
        known = versions(folder)
        if not known:
            return {"version": 0, "fields": [], "files": []}
        version = known[-1]
    return json.loads(bytes(store.array(f"{folder}/v{version:08d}.json", "u1")))


def commit(folder: str, base: dict, files: list[dict], fields: list[dict] | None = None) -> dict:
    """Writes the version after base, with base's columns by default; raises Conflict if there is one already."""
    new = {"version": base["version"] + 1, "fields": base["fields"] if fields is None else fields, "files": sorted(files, key=lambda f: f["name"])}
    name = f"{folder}/v{new['version']:08d}.json"
    path = store.local_path(name)
    if path is None:
        if new["version"] in versions(folder):
            raise Conflict(name)
        store.put(name, lambda f: f.write(json.dumps(new).encode()))
        return new
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "w") as f:
        json.dump(new, f)
    try:
        os.link(part, path)  # unlike a rename, this never replaces a version
    except FileExistsError as e:
        raise Conflict(name) from e
    finally:
        os.remove(part)
    return new


_MADE = "name string, rows long, bytes long"


def _write(folder: str, table: pa.Table) -> dict:
    name = f"s-{uuid.uuid4().hex}.parquet"
    out = pa.BufferOutputStream()
    pq.write_table(table, out, compression="zstd")
    data = out.getvalue()
    store.put(f"{folder}/{name}", lambda f: f.write(data))
    return {"name": name, "rows": table.num_rows, "bytes": data.size}


def merged_fields(known: list[dict], docs: DataFrame) -> list[dict]:
    """The known columns and those that docs has beside them, by names without regard to case; ValueError if a type differs."""
    of = {f["name"].lower(): f for f in known}
    for field in docs.schema.fields:
        old = of.setdefault(field.name.lower(), StructField(field.name, field.dataType).jsonValue())
        if StructField.fromJson(old).dataType.simpleString() != field.dataType.simpleString():
            raise ValueError(f"the column {field.name} has another type in the store")
    return list(of.values())


def append(docs: DataFrame, folder: str) -> dict:
    """Appends docs (doc_id, text and any others) with all their columns as small shards, and commits; the new manifest.

    A column that other arrivals lack is null in their rows. Nulls, repeated rows and rows
    without a doc_id are kept as they are, and an empty table adds a version without files.
    A column whose type differs from the store's raises ValueError, and nothing is committed.
    """

    def write(batches):
        held, size = [], 0
        for batch in batches:
            batch = batch.rename_columns(own)
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                held.append(part)
                size += part.nbytes
                if size >= ARRIVAL_BYTES:
                    yield pa.RecordBatch.from_pylist([_write(folder, pa.Table.from_batches(held))])
                    held, size = [], 0
        if held and any(b.num_rows for b in held):
            yield pa.RecordBatch.from_pylist([_write(folder, pa.Table.from_batches(held))])

    casts = {"doc_id": "long", "text": "string"}
    docs = docs.withColumns({name: F.col(name).cast(kind) for name, kind in casts.items()})
    known = {f["name"].lower(): f["name"] for f in merged_fields(manifest(folder)["fields"], docs)}
    own = [known[c.lower()] for c in docs.columns]
    numbered = docs.toDF(*[f"c{i}" for i in range(len(own))])  # workers take no names with dots
    made = [r.asDict() for r in numbered.mapInArrow(write, _MADE).collect()]  # a line for each file; a task that ran twice leaves a file that no manifest names
    base = manifest(folder)
    return commit(folder, base, base["files"] + made, merged_fields(base["fields"], docs))


def tier(size: int) -> int:
    """The tier of a file of so many bytes."""
    t = 0
    while size > LEAST_BYTES * FANOUT**t:
        t += 1
    return t


def plan(files: list[dict], target: int = TARGET_BYTES) -> list[list[dict]]:
    """The merges that are due: groups of files of one tier, each up to the target size together."""
    tiers: dict[int, list[dict]] = {}
    for f in files:
        if f["bytes"] < target // 2:
            tiers.setdefault(tier(f["bytes"]), []).append(f)
    groups = []
    for _, same in sorted(tiers.items()):
        if len(same) < FANOUT:
            continue
        group, size = [], 0
        for f in sorted(same, key=lambda f: f["name"]):
            if group and size + f["bytes"] > target:
                groups.append(group)
                group, size = [], 0
            group.append(f)
            size += f["bytes"]
        groups.append(group)
    return [g for g in groups if len(g) > 1]


def compact(spark: SparkSession, folder: str, target: int = TARGET_BYTES) -> dict:
    """Merges until no tier holds FANOUT files; one commit for each pass. Old files stay for readers of old versions."""
    now = manifest(folder)
    while groups := plan(now["files"], target):

        def merge(batches):
            for batch in batches:
                for group in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_pylist([_write(folder, pa.concat_tables([store.read_table(f"{folder}/{n}") for n in group], promote_options="default"))])

        work = spark.createDataFrame([([f["name"] for f in g],) for g in groups], "names array<string>").repartition(len(groups))
        made = [r.asDict() for r in work.mapInArrow(merge, _MADE).collect()]
        gone = {f["name"] for g in groups for f in g}
        now = commit(folder, now, [f for f in now["files"] if f["name"] not in gone] + made)
    return now


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The documents of a version: their columns, and shard (the name of their file; shard_ and so on if shard is one of theirs)."""
    now = manifest(folder, version)
    schema = StructType.fromJson({"type": "struct", "fields": now["fields"]}) if now["fields"] else "doc_id long, text string"
    rows = spark.read.schema(schema).parquet(*[f"{folder}/{f['name']}" for f in now["files"]]) if now["files"] else spark.createDataFrame([], schema)
    return rows.withColumn(names.free("shard", rows.columns), F.element_at(F.split(F.input_file_name(), "/"), -1))


def op6_compaction(spark, sf_dir: str) -> DataFrame:
    """All documents arrive in four batches, are compacted, and are read from the last version: doc_id, n_chars, text_md5 (null for null), lang, source."""
    folder = storage.new_path(spark, "compaction")
    docs = storage.table(spark, sf_dir, "documents")
    for k in range(4):
        append(docs.where(F.coalesce(F.pmod(F.col("doc_id"), F.lit(4)), F.lit(0)) == k), folder)
        compact(spark, folder)
    return read(spark, folder).select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source")


ORACLE = "SELECT doc_id, length(text)::BIGINT AS n_chars, md5(text) AS text_md5, lang, source FROM documents"
