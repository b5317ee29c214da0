import __spark_entry__ as entry
from weftgraph import storage
from weftgraph.operators import counting, graph, motif
from weftgraph.plans import catalog
from weftgraph.sources import graphs


def test_contract():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(catalog.QUERIES) <= set(queries) and set(oracles) <= set(queries)
    assert len(catalog.QUERIES) > 80 and "triangle_count" in queries


def test_anchors(spark):
    """Counts of the driver's smallest tables that are known from elsewhere."""
    d = "/root/testdata/sf0.001"
    parts = storage.table(spark, d, "part").where("p_size <= 5").select("p_partkey").withColumnRenamed("p_partkey", "id")
    small = storage.materialize(graph.induced(graphs.co_purchase(spark, d), parts), "small")
    census = {r["pattern"]: r["cnt"] for r in motif.motif4(small).collect()}
    assert census == {"3star": 734, "4path": 2348, "tailedtriangle": 1946, "rectangle": 461, "diamond": 779, "4clique": 126}
    for shape, n in (("closedhouse", 3399), ("dumbbell", 62345), ("6path", 1212753), ("house", 28232)):
        assert counting.count(small, shape) == n
    assert entry.entry(spark).count() == 1


def test_entry_without_the_subpackage(tmp_path):
    """The entry imports, with its other queries, when the training-data operators or what they need are missing."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/weftgraph", f"{tmp_path}/weftgraph")
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{root}/{name}"):
            shutil.copy(f"{root}/{name}", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()))"
    run = lambda c: int(subprocess.run([sys.executable, "-c", c], cwd=tmp_path, capture_output=True, check=True, text=True, env=os.environ | {"PYTHONPATH": ""}).stdout)
    n = len(catalog.QUERIES)
    assert run(f"import sys; sys.modules['xxhash'] = None; {code}") == n
    shutil.rmtree(f"{tmp_path}/weftgraph/llm", ignore_errors=True)
    assert run(code) == n
    if os.path.exists(f"{tmp_path}/corpus_pipeline.py"):
        os.remove(f"{tmp_path}/corpus_pipeline.py")
    assert run(code) == n
