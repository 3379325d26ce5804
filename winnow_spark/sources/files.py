"""Source trees and single files as rows of text."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow_spark.session import cut_lineage

MAX_BYTES = 2 * 1024 * 1024
SCHEMA = "ord long, id string, text string"
# Folders that are never entered, and endings of text files.
SKIPPED = (
    "node_modules", ".git", "dist", "build", "out", "coverage", ".next",
    "vendor", "__pycache__", ".venv", "venv", "target", ".cache",
)
TEXT = (
    ".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".py", ".rb", ".go", ".rs",
    ".java", ".kt", ".swift", ".c", ".h", ".cc", ".cpp", ".hpp", ".cs", ".php",
    ".scala", ".sh", ".bash", ".zsh", ".sql", ".vue", ".svelte", ".json", ".jsonc",
    ".yaml", ".yml", ".toml", ".md", ".txt", ".env", ".ini", ".cfg", ".xml", ".html", ".css",
)
#: Files to a task when their contents are read.
FILES_A_TASK = 256


def is_text_name(name: str) -> bool:
    """By the ending; a file named like a bare ending, such as ``.env``, has it."""
    return ("." + name.rsplit(".", 1)[-1]).lower() in TEXT if "." in name else False


def list_files(root: str, skip: Iterable[str] = SKIPPED, max_files: int | None = None) -> list[str]:
    """Paths below a local ``root`` in order: text by name, at most 2 MiB, no links, no skipped names, and of hidden ones ``.env`` only."""
    skip, found = set(skip), []

    def walk(folder: str, inside: str) -> None:
        try:
            entries = list(os.scandir(folder))
        except OSError:  # not readable: left out
            return
        for entry in entries:
            name, path = entry.name, f"{inside}{entry.name}"
            if name in skip or entry.is_symlink() or (name.startswith(".") and name != ".env"):
                continue
            if entry.is_dir():
                walk(entry.path, f"{path}/")
            elif entry.is_file() and is_text_name(name) and entry.stat().st_size <= MAX_BYTES:
                found.append(path)

    walk(root, "")
    return sorted(found)[:max_files]


def _read(spark: SparkSession, files: list[tuple[int, str, str]]) -> DataFrame:
    """ord, id, text of (ord, id, path); contents are read by the executors, bytes that are no UTF-8 become U+FFFD."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 32):
                part = batch.iloc[at : at + 32]
                texts = []
                for path in part["path"]:
                    with open(path, "rb") as file:
                        texts.append(file.read().decode("utf-8", "replace"))
                yield part[["ord", "id"]].assign(text=texts)

    if not files:
        return spark.createDataFrame([], SCHEMA)
    listed = spark.createDataFrame(files, "ord long, id string, path string")
    return listed.repartitionByRange(-(-len(files) // FILES_A_TASK), "ord").mapInPandas(read, SCHEMA)


def scan_files(spark: SparkSession, root: str, max_files: int | None = None, skip: Iterable[str] = SKIPPED) -> DataFrame:
    """ord (a number), id (path under ``root``) and text of a tree's text files, in order of path.

    A local root is listed by the driver (names only) and read by the executors,
    which must see it. Any other root, such as ``hdfs://...``, is listed and read
    by Spark, whose listing leaves out all names that begin with ``.`` or ``_``.
    """
    root = root.removeprefix("file://")
    if "://" not in root:
        if not os.path.exists(root):
            raise FileNotFoundError(f"cannot read {root!r}: no such file or directory")
        root = os.path.realpath(root)
        return _read(spark, [(k, path, f"{root}/{path}") for k, path in enumerate(list_files(root, skip, max_files))])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= MAX_BYTES)
    folder = root.split("://", 1)[1].partition("/")[2].strip("/")
    below = F.substring("path", F.instr("path", f"/{folder}/") + len(folder) + 2, F.length("path"))
    inside = below if folder else F.regexp_replace("path", r"^[A-Za-z0-9+.-]+:/+[^/]*/", "")
    files = files.select(inside.alias("id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    names = F.split("id", "/")
    ending = F.lower(F.concat(F.lit("."), F.regexp_extract(F.element_at(names, -1), r"\.([^.]+)$", 1)))
    files = files.where(~F.exists(names, lambda n: n.isin(list(skip))) & ending.isin(list(TEXT))).orderBy("id")
    files = files.limit(max_files) if max_files is not None else files
    return cut_lineage(files.select(F.monotonically_increasing_id().alias("ord"), "id", "text"))


def read_files(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """ord, id (the path as given) and text of single files, of any size and ending; a missing one is an error."""
    paths = list(paths)
    for path in paths:
        if not os.path.isfile(path):
            raise FileNotFoundError(f"cannot read {path!r}: no such file")
    return _read(spark, [(k, path, os.path.realpath(path)) for k, path in enumerate(paths)])


def collect_files(spark: SparkSession, paths: Iterable[str], max_files: int | None = None) -> DataFrame:
    """The rows of folders and single files in the order given; ``ord`` goes on from one to the next."""
    parts = []
    for number, path in enumerate(paths):
        rows = read_files(spark, [path]) if os.path.isfile(path) else scan_files(spark, path, max_files)
        parts.append(rows.withColumn("ord", F.col("ord") + (number << 48)))
    out = parts[0] if parts else spark.createDataFrame([], SCHEMA)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def text_rows(spark: SparkSession, texts: Iterable[str | None], ids: Iterable[str] | None = None) -> DataFrame:
    """ord, id, text of texts in memory; without ``ids``, the only or numbered ``input``."""
    texts = list(texts)
    ids = list(ids) if ids is not None else ["input"] if len(texts) == 1 else [f"input{k}" for k in range(len(texts))]
    return spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)
