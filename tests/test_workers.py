"""Python code that runs on executors must not need the package installed there."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from tidepool.session import build_session, work_path
from tidepool.sources import jsonio
spark = build_session("local[2]")
df = spark.range(0, 50, numPartitions=3).selectExpr("id", "cast(id as string) AS s")
path = work_path(spark, "t_worker_json")
jsonio.export_json(df, path, array=True)
print("rows", jsonio.read_json(spark, path, schema=df.schema, array=True).count())
"""


def test_array_export_from_another_working_directory():
    # workers start in a folder without the package, as on a cluster
    cwd = tempfile.mkdtemp(prefix="tp-worker-")
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, capture_output=True,
                         text=True, timeout=600)
    assert "rows 50" in out.stdout, out.stderr[-3000:]


HELD = f"""
import sys
sys.path.insert(0, {ROOT!r})
import numpy as np
from tidepool.llm.common import releasing

def resident():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6

@releasing
def task(batches):
    blocks = [np.ones(8_000) for _ in range(4_000)]  # 256 MB in blocks that the C library keeps
    kept.append(np.ones(8_000))  # the last one stays
    yield len(blocks)

kept = []
before = resident()
assert list(task(iter([]))) == [4_000]
print("kept", resident() - before < 64)
"""


def test_a_finished_task_gives_back_its_arrays():
    # the last block is still in use, so the others lie below what the C library frees by itself
    out = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, timeout=120,
                         env={**os.environ, "MALLOC_MMAP_THRESHOLD_": "33554432"})
    assert "kept True" in out.stdout, out.stdout + out.stderr[-3000:]


def test_batches_to_workers_are_small_in_every_stage_of_the_pipeline(spark):
    import corpus_pipeline
    from tidepool.session import ARROW_BATCH
    name, _ = ARROW_BATCH

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_pydict({"mb": [b.nbytes / 1e6]})

    had = spark.conf.get(name, None)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(name)
            docs = spark.createDataFrame([(1, "a text of a few words", "en", "web", 21)], "doc_id long, text string, lang string, source string, n_chars long")
            stage(spark, docs, "/root/testdata/sf0.001")
            big = spark.range(0, 9_000, 1, 1).selectExpr("repeat('word ', 600) AS text")
            assert max(r.mb for r in big.mapInArrow(sizes, "mb double").collect()) < 8
        spark.conf.set(name, "16m")  # a session's own setting holds
        corpus_pipeline.STAGES[1][1](spark, docs, "/root/testdata/sf0.001")
        assert spark.conf.get(name) in ("16m", str(16 << 20), f"{16 << 20}b")
    finally:
        spark.conf.set(name, had) if had is not None else spark.conf.unset(name)


def test_pair_walk_holds_little_besides_its_points():
    import tracemalloc

    import numpy as np
    from tidepool.llm import jaccard
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, (64, 1024))
    points = (base[rng.integers(0, 64, 2048)] + (rng.random((2048, 1024)) < 0.02)).astype(np.uint16)
    comp = np.arange(2048)
    tracemalloc.start()
    found = jaccard.tree_pairs(points, comp, 95, 100)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    wide = jaccard.tree_pairs(points.astype(np.int64), comp, 95, 100)
    pairs = {tuple(p) for f in found for p in np.sort(f, axis=1).tolist()}
    assert pairs and pairs == {tuple(p) for f in wide for p in np.sort(f, axis=1).tolist()}
    assert peak < 5 * points.nbytes / 1e6, peak


SHUFFLED = f"""
import sys, time
sys.path.insert(0, {ROOT!r})
from pathlib import Path
from tidepool.llm.components import components
from tidepool.session import build_session, work_path
spark = build_session("local[2]", shuffle_partitions=4)
links = spark.range(0, 900, numPartitions=3).selectExpr("id AS a", "id + 1000 AS b").union(spark.range(0, 900).selectExpr("id", "id + 2000"))
path = work_path(spark, "t_components")
part = components(links, path)
left = lambda: [f for f in Path(sys.argv[1]).rglob("shuffle_*") if f.stat().st_size > 1_000]
until = time.time() + 20
while left() and time.time() < until:
    time.sleep(0.5)
print("files", len(left()), "tables", len(list(Path(path.removeprefix("file:")).iterdir())), "nodes", part.count())
"""


def test_no_shuffle_files_of_written_rounds_stay(tmp_path):
    out = subprocess.run([sys.executable, "-c", SHUFFLED, str(tmp_path)], capture_output=True, text=True, timeout=300,
                         env={**os.environ, "SPARK_LOCAL_DIRS": str(tmp_path)})
    assert "tables 1 nodes 2700" in out.stdout, out.stdout + out.stderr[-3000:]
    assert "files 0 " in out.stdout, out.stdout
