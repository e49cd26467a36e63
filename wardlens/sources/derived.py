"""Load a derived table, or derive and save it (S3).

A table's folder is named by a digest of what it is made of: the builder's plan, the
caller's parameters, and path, length and modification time of every input file. So a changed
input, parameter or plan has another folder, and an unchanged one is read. A write goes to a
folder of its own and counts only when a commit marker that names it has been written; a
half-written table is never read, and of two writers at once the first name in order wins.
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "commit"


def plan_text(df: DataFrame) -> str:
    """The analysed plan without the numbers that differ from session to session."""
    spark = df.sparkSession
    wide, kept = "spark.sql.debug.maxToStringFields", None
    kept = spark.conf.get(wide, None)
    spark.conf.set(wide, 100_000)
    try:
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain("extended")
    finally:
        spark.conf.unset(wide) if kept is None else spark.conf.set(wide, kept)
    text = re.search(r"== Analyzed Logical Plan ==\n(.*?)\n== Optimized", out.getvalue(), re.S).group(1)
    return re.sub(r"plan_id=\d+|#\d+L?|@[0-9a-f]+", "", text)


def files_digest(spark: SparkSession, paths: Sequence[str]) -> str:
    """Digest of path, length and modification time of the files, whatever their order. Their
    content is not read; the listing is a distributed scan that returns one row."""
    if not paths:
        return "none"
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "length", "modificationTime")
    h = [F.xxhash64(F.lit(seed), "path", "length", "modificationTime").cast("decimal(38,0)") for seed in (1, 2)]
    return "-".join(str(x) for x in files.agg(F.count(F.lit(1)), F.sum(h[0]), F.sum(h[1])).first())


def content_address(df: DataFrame, params: Mapping | None = None) -> str:
    spark = df.sparkSession
    text = json.dumps([plan_text(df), dict(params or {}), files_digest(spark, sorted(df.inputFiles()))], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def committed(spark: SparkSession, home: str) -> str | None:
    """The folder of the committed table under ``home``, if there is one."""
    marks = [n[len(MARKER) + 1:] for n in _names(spark, home) if n.startswith(MARKER + "-")]
    return f"{home}/data-{marks[0]}" if marks else None


def load_or_derive(spark: SparkSession, root: str, name: str, build: Callable[[], DataFrame],
                   params: Mapping | None = None) -> tuple[DataFrame, bool]:
    """(table, loaded): the saved result of ``build`` under ``root``, which every executor must
    reach, or a new one. ``build`` declares its plan and is run only if no committed table has
    its address. What the plan's text and files do not show (rows given by the driver, the code
    of a Python function) belongs in ``params``."""
    df = build()
    home = f"{root.rstrip('/')}/{name}-{content_address(df, params)}"
    at = committed(spark, home)
    if at:
        return spark.read.schema(df.schema).parquet(at), True
    mark = uuid.uuid4().hex
    df.write.parquet(f"{home}/data-{mark}")
    fs, p = _fs(spark, f"{home}/{MARKER}-{mark}")
    fs.create(p, False).close()  # an empty file appears whole or not at all
    return spark.read.schema(df.schema).parquet(committed(spark, home)), False


def drop_stale(spark: SparkSession, root: str, name: str, keep: Sequence[DataFrame] = (), params: Mapping | None = None) -> list[str]:
    """Delete the saved tables of ``name`` other than those that ``keep`` would load, and
    half-written ones; their folders' names come back. Not while others write there."""
    wanted = {f"{name}-{content_address(df, params)}" for df in keep}
    gone = []
    for folder in _names(spark, root):
        if not re.fullmatch(re.escape(name) + "-[0-9a-f]{32}", folder):
            continue
        home = f"{root.rstrip('/')}/{folder}"
        at = committed(spark, home)
        parts = [n for n in _names(spark, home) if n.startswith("data-") and f"{home}/{n}" != at]
        drop = [home] if folder not in wanted or at is None else [f"{home}/{n}" for n in parts]
        for path in drop:
            fs, p = _fs(spark, path)
            fs.delete(p, True)
            gone.append(path[len(root.rstrip("/")) + 1:])
    return gone
