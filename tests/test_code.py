"""Scanning and parsing of source files, and an index run with offline providers."""

import hashlib

from pyspark.sql import functions as F

from tessera.operators import entities as E
from tessera.plans.index import index
from tessera.schemas import ENTITY
from tessera.sources import code

FILES = {
    "a.py": "@deco\ndef alpha(a, b, *c, d=1) -> int:\n    return 1\n\nclass Thing(Base, x.Y):\n    def go(self):\n        def inner():\n            pass\n        return 2\n\nif True:\n    def hidden():\n        pass\n",
    "pkg/b.py": "async def fetch(x, /, y):\n    pass\n\ndef same():\n    return 1\n",
    "pkg/c.py": "def same():\n    return 1\n",
    "bad.py": "def broken(:\n",
    "venv/v.py": "def v(): pass\n",
    "x.egg-info/e.py": "def e(): pass\n",
    "note.txt": "def no(): pass\n",
    "empty.py": "",
}


def tree(tmp_path, files=FILES):
    for name, text in files.items():
        path = tmp_path / "env" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "env" / "bytes.py").write_bytes(b"\xff\xfe\x00")
    return str(tmp_path / "env")


def parsed(spark, root):
    return code.parse_files(code.scan_files(spark, root)).withColumn("ordinal", F.col("ordinal"))


def test_definitions(spark, tmp_path):
    got = {(r.file_path, r.qualname): r for r in parsed(spark, tree(tmp_path)).collect()}
    assert set(got) == {("a.py", "alpha"), ("a.py", "Thing"), ("a.py", "Thing.go"), ("pkg/b.py", "fetch"), ("pkg/b.py", "same"), ("pkg/c.py", "same")}
    alpha = got["a.py", "alpha"]
    assert (alpha.entity_type, alpha.signature, alpha.start_line, alpha.end_line) == ("function", "def alpha(a, b) -> ...:", 2, 3)
    assert alpha.source_code.startswith("def alpha") and alpha.content_hash == hashlib.sha256(alpha.source_code.encode()).hexdigest()
    assert got["a.py", "Thing"].signature == "class Thing(Base):" and got["a.py", "Thing.go"].entity_type == "method"
    assert got["pkg/b.py", "fetch"].signature == "def fetch(x, y):"
    assert got["pkg/b.py", "same"].content_hash == got["pkg/c.py", "same"].content_hash


def test_index_runs(spark, tmp_path):
    now, calls = F.lit("2024-01-01").cast("timestamp"), []
    write = lambda df: _written(spark, tmp_path, df, calls)
    root = tree(tmp_path)
    empty, vectors = spark.createDataFrame([], ENTITY), spark.createDataFrame([], "entity_id long, embedding array<float>, entity_type string")
    first, made, diffed = index(parsed(spark, root), empty, vectors, "p", "run1", now, write)
    first, made = write(first), write(made)
    assert first.count() == 6 and made.count() == 6 and E.diff_summary(diffed).first().changed == 6
    again, _, diffed = index(parsed(spark, root), first, made, "p", "run2", now, write)
    assert E.diff_summary(diffed).first().asDict() == {"changed": 0, "moved": 0, "unchanged": 6, "reused": 6, "reuse_ratio": 1.0}
    assert {r.id for r in again.collect()} == {r.id for r in first.collect()}
    tree(tmp_path, {"a.py": "\n" + FILES["a.py"].replace("return 2", "return 3"), "pkg/c.py": "x = 1\n"})
    third, made, diffed = index(parsed(spark, root), first, made, "p", "run3", now, write)
    # alpha moved; the class holds the method, so both changed; pkg/c.py's function is gone
    assert {r.qualname: r.bucket for r in diffed.where("file_path = 'a.py'").collect()} == {"alpha": "moved", "Thing": "changed", "Thing.go": "changed"}
    before, after = {(r.file_path, r.qualname): r for r in first.collect()}, {(r.file_path, r.qualname): r for r in third.collect()}
    assert set(before) - set(after) == {("pkg/c.py", "same")} and all(after[k].id == before[k].id for k in after)
    assert {r.entity_id for r in made.collect()} == {r.id for r in after.values()}


def _written(spark, tmp_path, df, calls):
    calls.append(1)
    path = str(tmp_path / f"w{len(calls)}")
    df.write.parquet(path)
    return spark.read.parquet(path)
