"""Source files: scan, tolerant decoding and parsing into definitions."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.entities import content_hash
from ..schemas import PARSED

#: Directories that hold no source of the project.
PRUNED = ("__pycache__", ".git", "node_modules", ".venv", "venv", "env", ".tox", ".eggs")


def scan_files(spark: SparkSession, root: str, suffix: str = ".py") -> DataFrame:
    """(file_path relative to root, content) of the files below root, without pruned directories.

    Only the part of the path below root is tested, so root itself may lie anywhere.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(root)
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    path = F.element_at(F.split("path", F.concat(F.lit(r"\Q"), F.lit(base), F.lit(r"\E")), 2), -1)
    directories = F.split("file_path", "/")
    kept = ~F.exists(F.slice(directories, 1, F.size(directories) - 1), lambda d: d.isin(*PRUNED) | d.endswith(".egg-info"))
    return files.select(path.alias("file_path"), "content").where(kept)


def tracked(files: DataFrame, listing: DataFrame) -> DataFrame:
    """The files that a version control system lists: listing has a path below the root in each line (value)."""
    return files.join(listing.select(F.trim("value").alias("file_path")).distinct(), "file_path", "left_semi")


def signature(node: ast.AST) -> str:
    if isinstance(node, ast.ClassDef):
        bases = ", ".join(b.id for b in node.bases if isinstance(b, ast.Name))
        return f"class {node.name}({bases}):" if bases else f"class {node.name}:"
    names = ", ".join(a.arg for a in [*node.args.posonlyargs, *node.args.args])
    return f"def {node.name}({names})" + (" -> ..." if node.returns else "") + ":"


def definitions(text: str):
    """(qualname, type, node) of a module's functions, classes and their direct methods, in source order."""
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    for node in ast.parse(text).body:
        if isinstance(node, functions):
            yield node.name, "function", node
        elif isinstance(node, ast.ClassDef):
            yield node.name, "class", node
            for part in node.body:
                if isinstance(part, functions):
                    yield f"{node.name}.{part.name}", "method", part


def parsed_or_not(files: DataFrame) -> DataFrame:
    """The definitions in (file_path, content), and a row with error alone for a file that can't be decoded or parsed."""
    names = ["file_path", "qualname", "entity_type", "signature", "source_code", "start_line", "end_line", "ordinal", "error"]
    types = [pa.string()] * 5 + [pa.int32(), pa.int32(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    text = content.decode("utf-8")
                    found = list(definitions(text))
                except (UnicodeDecodeError, SyntaxError, ValueError, RecursionError) as e:
                    rows.append((path, *[None] * 7, f"{type(e).__name__}: {e}"[:500]))
                    continue
                for i, (name, kind, node) in enumerate(found):
                    rows.append((path, name, kind, signature(node), ast.get_source_segment(text, node) or "", node.lineno, node.end_lineno, i, None))
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    schema = "file_path string, qualname string, entity_type string, signature string, source_code string, start_line int, end_line int, ordinal long, error string"
    return files.select("file_path", "content").mapInArrow(run, schema)


def parse_files(files: DataFrame) -> DataFrame:
    """The definitions in (file_path, content); a file that can't be decoded or parsed gives none.

    ordinal orders the definitions of a file; decorators are not part of a definition's source.
    """
    parsed = parsed_or_not(files).where("error is null").drop("error")
    return parsed.withColumn("content_hash", content_hash(F.col("source_code"))).select(*[c.strip().split(" ")[0] for c in PARSED.split(",")])


def unreadable(files: DataFrame) -> DataFrame:
    """(file_path, error) of the files that can't be decoded or parsed."""
    return parsed_or_not(files).where("error is not null").select("file_path", "error")


def repository(url):
    """(owner, name) of a repository URL column; null without two path parts."""
    parts = F.filter(F.split(F.regexp_replace(F.rtrim(F.trim(F.parse_url(url, F.lit("PATH"))), F.lit("/")), r"\.git$", ""), "/"), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.struct(F.get(parts, F.lit(0)).alias("owner"), F.get(parts, F.lit(1)).alias("name")))
