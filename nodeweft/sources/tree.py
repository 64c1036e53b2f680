"""Source trees, uploads and manifests as DataFrames."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories that are never scanned.
EXCLUDED = ("__pycache__", "node_modules", "venv", ".venv", "env", "site-packages", "dist", "build", "migrations")
EXCLUDED_PHP = (*EXCLUDED, "vendor")
LANGUAGES = {".py": "python", ".php": "php"}
UPLOAD_LIMIT = 2 * 1024 * 1024
#: As soon as so many directories are known and not yet listed, the executors list them.
LISTED_HERE = 200


def suffix_language(file):
    """python or php by the suffix, which is case-sensitive; null for other files."""
    return F.when(F.col(file).endswith(".py"), "python").when(F.col(file).endswith(".php"), "php")


def _below(system: fs.FileSystem, base: str, todo: list[str], suffix: str, excluded: tuple[str, ...], enough: int | None = None) -> Iterator[str]:
    """The relative paths of the files below the directories of `todo`; ends early, with the rest left in `todo`, once that
    holds `enough` directories. (Spark's own file sources can't serve: they pass over names with a leading underscore,
    __init__.py among them, and over empty files.)"""
    while todo and (enough is None or len(todo) < enough):
        below = todo.pop(0)
        infos = system.get_file_info(fs.FileSelector(f"{base}/{below}".rstrip("/")))
        if below and any(i.base_name == "pyvenv.cfg" for i in infos):
            continue
        for i in infos:
            name = i.base_name
            path = f"{below}/{name}" if below else name
            if i.type == fs.FileType.Directory:
                if not name.startswith(".") and name not in excluded:
                    todo.append(path)
            elif name.endswith(suffix):
                yield path


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))
    return system, base.rstrip("/")


def scan_tree(spark: SparkSession, root: str, suffix: str = ".py", excluded: tuple[str, ...] | None = None) -> DataFrame:
    """(file, lang, content, sha1) of the files below `root`, a folder or URI that every executor sees: content as text,
    sha1 of the raw bytes.

    Left out: directories in `excluded`, those whose name begins with a dot, virtual environments (directories that hold a
    pyvenv.cfg), and files that can't be read. Undecodable bytes are dropped from the text.
    """
    excluded = excluded if excluded is not None else EXCLUDED_PHP if suffix == ".php" else EXCLUDED
    todo = [""]
    # The upper directories are listed here, the many below them by the executors.
    paths = list(_below(*file_system(root), todo, suffix, excluded, LISTED_HERE))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = list(_below(system, base, [path], suffix, excluded))
                yield pa.RecordBatch.from_pydict({"file": pa.array(found, type=pa.string())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with system.open_input_stream(f"{base}/{path}") as f:
                        data = f.read()
                except OSError:
                    continue
                yield pa.RecordBatch.from_pydict({"file": [path], "content": [data.decode("utf-8", "ignore")], "sha1": [hashlib.sha1(data).hexdigest()]})

    tasks = spark.sparkContext.defaultParallelism * 4
    names = spark.createDataFrame([(p,) for p in paths], "file string")
    if todo:
        names = names.unionByName(spark.createDataFrame([(p,) for p in todo], "file string").repartition(min(len(todo), tasks)).mapInArrow(listed, "file string"))
    found = names.repartition(tasks if todo else max(1, min(len(paths), tasks))).mapInArrow(read, "file string, content string, sha1 string")
    return found.select("file", suffix_language("file").alias("lang"), "content", "sha1")


def uploaded(spark: SparkSession, files: list[dict], skipped: list[dict] | None = None) -> DataFrame:
    """Uploaded `{path, content}` items as files. Paths that leave the upload, skipped directories, other suffixes and
    files over the size limit are left out and added to `skipped` as {path, reason}; an upload without a file left is an
    error."""
    rows = []
    skipped = skipped if skipped is not None else []
    for item in files:
        path = os.path.normpath(str(item.get("path", "")).replace("\\", "/"))
        content = item.get("content") or ""
        reason = None
        if path.startswith(("/", "..")):
            reason = "outside the upload"
        elif os.path.splitext(path)[1] not in LANGUAGES:
            reason = "not a source file"
        elif len(content.encode()) > UPLOAD_LIMIT:
            reason = f"over {UPLOAD_LIMIT} bytes"
        elif any(d.startswith(".") or d in EXCLUDED_PHP for d in path.split("/")[:-1]):
            reason = "in a skipped directory"
        if reason:
            skipped.append({"path": str(item.get("path", "")), "reason": reason})
        else:
            rows.append((path, content))
    if not rows:
        raise ValueError("the upload holds no source file")
    df = spark.createDataFrame(rows, "file string, content string")
    return df.select("file", suffix_language("file").alias("lang"), "content", F.sha1("content").alias("sha1"))


def manifest(files: DataFrame) -> DataFrame:
    """(file, sha1) of the files whose content could be read: the hash of the raw bytes that the scan carries, or that of the
    text where a table carries none."""
    hashed = F.sha1("content")
    if "sha1" in files.columns:
        hashed = F.coalesce("sha1", hashed)
    return files.where(F.col("content").isNotNull()).select("file", hashed.alias("sha1"))


def dotted_module(file):
    """pkg/mod.py as pkg.mod, pkg/__init__.py as pkg; a root __init__.py stays __init__."""
    dotted = F.regexp_replace(F.regexp_replace(file, r"\.py$", ""), "/", ".")
    return F.regexp_replace(dotted, r"\.__init__$", "")
