"""Reading and writing graphs: binary CSR files, text edge lists, and pattern files.

CSR: prefix.meta.txt, prefix.vertex.bin (int64 row offsets, one more than vertices),
prefix.edge.bin (int32 or int64 neighbours), prefix.vlabel.bin and prefix.elabel.bin
(optional). Files are read in ranges by Spark's tasks, so no task holds a whole one.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.graph import degrees, row_offsets
from weftgraph.plans.pattern import Pattern
from weftgraph.sources.graphs import normalise

_INT = {1: "<u1", 2: "<u2", 4: "<i4", 8: "<i8"}


@dataclass
class Meta:
    """What graph.meta.txt says; vertices of the second side are other than 0 for bipartite graphs alone."""

    vertices: int
    edges: int
    vid_bytes: int = 4
    eid_bytes: int = 8
    vlabel_bytes: int = 1
    elabel_bytes: int = 2
    max_degree: int = 0
    features: int = 0
    vclasses: int = 0
    eclasses: int = 0
    second_side: int = 0

    @staticmethod
    def parse(text: str, bipartite: bool = False) -> Meta:
        numbers = [int(x) for line in text.splitlines() for x in line.split()]
        second = numbers.pop(1) if bipartite else 0
        if len(numbers) < 2:
            raise ValueError("a meta file has the numbers of vertices and edges")
        return Meta(*numbers[:10], second_side=second)

    def text(self) -> str:
        first = f"{self.vertices} {self.second_side}" if self.second_side else f"{self.vertices}"
        return f"{first}\n{self.edges}\n{self.vid_bytes} {self.eid_bytes} {self.vlabel_bytes} {self.elabel_bytes}\n{self.max_degree}\n{self.features}\n{self.vclasses}\n{self.eclasses}\n"


def _open(path: str):
    """(file to read from at any place, size)."""
    if "://" in path and not path.startswith("file:"):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        return store.open_input_file(inner), store.get_file_info(inner).size
    local = path.removeprefix("file://").removeprefix("file:")
    return open(local, "rb"), os.path.getsize(local)


def _numbers(path: str, dtype: str, start: int, n: int) -> np.ndarray:
    f, _ = _open(path)
    with f:
        f.seek(start * np.dtype(dtype).itemsize)
        return np.frombuffer(f.read(n * np.dtype(dtype).itemsize), dtype)


def read_meta(prefix: str, bipartite: bool = False) -> Meta:
    """The graph's meta file."""
    f, _ = _open(f"{prefix}.meta.txt")
    with f:
        return Meta.parse(bytes(f.read()).decode(), bipartite)


def read_csr(spark: SparkSession, prefix: str, edge_labels: bool = False, bipartite: bool = False, chunk: int = 1 << 20) -> DataFrame:
    """edges (src, dst[, elabel]) as they are stored, in ranges of about chunk edges."""
    meta = read_meta(prefix, bipartite)
    n = meta.vertices + meta.second_side
    kind = _INT[meta.vid_bytes]
    ranges = max(1, min(n, -(-meta.edges // chunk)))
    step = max(1, -(-n // ranges))

    def load(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                lo, hi = k * step, min(n, (k + 1) * step)
                if lo >= hi:
                    continue
                rows = _numbers(f"{prefix}.vertex.bin", "<i8", lo, hi - lo + 1)
                for a in range(0, hi - lo, 65536):  # a few vertices at a time; a hub's neighbours are one piece
                    at = rows[a : min(hi - lo, a + 65536) + 1]
                    m = int(at[-1] - at[0])
                    src = np.repeat(np.arange(lo + a, lo + a + len(at) - 1, dtype=np.int64), np.diff(at))
                    columns = {"src": src, "dst": _numbers(f"{prefix}.edge.bin", kind, int(at[0]), m).astype(np.int64)}
                    if edge_labels:
                        columns["elabel"] = _numbers(f"{prefix}.elabel.bin", _INT[meta.elabel_bytes], int(at[0]), m).astype(np.int32)
                    yield pa.RecordBatch.from_pydict(columns)

    parts = spark.range(0, ranges, 1, min(ranges, 100_000))
    return parts.mapInArrow(load, "src long, dst long" + ", elabel int" * edge_labels)


def read_vertex_labels(spark: SparkSession, prefix: str, chunk: int = 1 << 20) -> DataFrame:
    """vertices (id, vlabel); raises if the file is missing, as labels are never made up."""
    meta = read_meta(prefix)
    f, size = _open(f"{prefix}.vlabel.bin")
    f.close()
    if size != meta.vertices * meta.vlabel_bytes:
        raise ValueError("the label file doesn't have a label for each vertex")
    ranges = max(1, -(-meta.vertices // chunk))

    def load(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                got = _numbers(f"{prefix}.vlabel.bin", _INT[meta.vlabel_bytes], k * chunk, min(chunk, meta.vertices - k * chunk))
                yield pa.RecordBatch.from_pydict({"id": np.arange(k * chunk, k * chunk + len(got), dtype=np.int64), "vlabel": got.astype(np.int32)})

    return spark.range(0, ranges, 1, min(ranges, 100_000)).mapInArrow(load, "id long, vlabel int")


def write_csr(edges: DataFrame, prefix: str, vertices: int, labels: DataFrame | None = None) -> Meta:
    """Writes edges (ids below vertices) as local CSR files; tables larger than one machine stay in parquet.

    Rows come to the driver part by part.
    """
    spark = edges.sparkSession
    top = degrees(edges).agg(F.max("degree").alias("m"), F.sum("degree").alias("e"), F.max("id").alias("i")).first()
    if top["i"] is not None and top["i"] >= vertices:
        raise ValueError("an id is beyond the number of vertices")
    meta = Meta(vertices, top["e"] or 0, max_degree=top["m"] or 0)
    os.makedirs(os.path.dirname(prefix) or ".", exist_ok=True)
    counts = np.zeros(vertices + 1, np.int64)
    for r in row_offsets(edges).select("id", "degree").toLocalIterator():
        counts[r["id"] + 1] = r["degree"]
    np.cumsum(counts).astype("<i8").tofile(f"{prefix}.vertex.bin")
    with open(f"{prefix}.edge.bin", "wb") as f:
        block: list[int] = []
        for r in edges.orderBy("src", "dst").select("dst").toLocalIterator():
            block.append(r["dst"])
            if len(block) == 1 << 16:
                np.array(block, "<i4").tofile(f)
                block = []
        np.array(block, "<i4").tofile(f)
    if labels is not None:
        out = np.zeros(vertices, "<u1")
        for r in labels.select("id", "vlabel").toLocalIterator():
            if not 0 <= r["vlabel"] < 256:
                raise ValueError("labels of one byte are written")
            out[r["id"]] = r["vlabel"]
        out.tofile(f"{prefix}.vlabel.bin")
        meta.vclasses = labels.select("vlabel").distinct().count()
    with open(f"{prefix}.meta.txt", "w") as f:
        f.write(meta.text())
    assert spark
    return meta


def read_edge_list(spark: SparkSession, path: str, directed: bool = False) -> DataFrame:
    """edges from text lines 'src dst ...' with any white space; lines that begin with # or % are comments."""
    rows = spark.read.text(path).where(~F.trim("value").rlike(r"^([#%].*)?$"))
    parts = F.split(F.trim("value"), r"\s+")
    pairs = rows.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"))
    return pairs.where("src <> dst").distinct() if directed else normalise(pairs)


def write_edge_list(edges: DataFrame, path: str) -> None:
    """Writes lines 'src dst'."""
    edges.select(F.concat_ws(" ", "src", "dst")).write.text(path)


def read_pattern(path: str) -> Pattern:
    """A pattern file."""
    with open(path) as f:
        return Pattern.parse(f.read())
