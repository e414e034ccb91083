"""Sinks: knowledge-base lines, labelled text lines, tables as Markdown, keyed feature tables."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import kb, kg


def append_lines(rows: DataFrame, path: str) -> None:
    """Append search or claim rows as JSON lines."""
    rows.drop("line_no").write.mode("append").json(path)


def purge_lines(spark: SparkSession, path: str) -> int:
    """Rewrite the search lines at `path` with the valid entries only, the old folder kept as path.bak-…; the number of entries dropped."""
    from .readers import search_lines

    rows = search_lines(spark, path)
    keep = kb.valid_entries(rows).select("mention", "record")
    before, after = kb.last_writes(rows).count(), keep.count()
    fresh, backup = f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.bak-{uuid.uuid4().hex[:8]}"
    keep.write.json(fresh)
    _rename(spark, path, backup)
    _rename(spark, fresh, path)
    return before - after


def labelled_lines(docs: DataFrame, path: str) -> None:
    """One `__label__x text` line per labelled article."""
    line = F.concat(F.lit("__label__"), F.when(F.col("label") == 1, "fake").otherwise("real"), F.lit(" "), X.collapsed(F.col("text")))
    docs.where("label is not null").select(line.alias("value")).write.mode("overwrite").text(path)


def crossview_object(crossview: DataFrame) -> DataFrame:
    """One row: the (qid, class_path) rows as a JSON object; for dimension tables that fit one row."""
    return crossview.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("qid", "class_path"))))).alias("json"))


def ontology_file(nodes: DataFrame, path: str) -> None:
    """Write (path, level, parent, attributes) as one nested JSON object under a root without attributes."""
    root = F.concat(F.lit('{"name":"root","level":0,"parent":null,"attributes":[],"children":'), "json", F.lit("}"))
    kg.nested(nodes).select(root.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A Markdown table of a report's rows, at most `limit`."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns) + "\n"
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    return head + "".join("| " + " | ".join(cell(v) for v in r) + " |\n" for r in rows.limit(limit).collect())


def fingerprint(settings: dict) -> str:
    """First 12 hex digits of the SHA-1 of the settings, independent of key order; values that JSON lacks are written as text."""
    return hashlib.sha1(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:12]


def settings_difference(old: dict, new: dict, prefix: str = "") -> list[str]:
    """Dotted keys whose values differ, sorted."""
    out: list[str] = []
    for k in sorted({*old, *new}):
        a, b, name = old.get(k), new.get(k), f"{prefix}{k}"
        if isinstance(a, dict) and isinstance(b, dict):
            out += settings_difference(a, b, name + ".")
        elif a != b or (k in old) != (k in new):
            out.append(name)
    return out


class KeyedTables:
    """Tables kept with the settings that made them; the manifest is written last, so a broken write is never taken for a table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, name: str, rows: DataFrame, settings: dict) -> DataFrame:
        folder = f"{self.root}/{name}"
        self.clear(name)
        rows.write.mode("overwrite").parquet(f"{folder}/rows")
        self.spark.createDataFrame([(json.dumps(settings, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
        return self.spark.read.parquet(f"{folder}/rows")

    def manifest(self, name: str) -> dict | None:
        path = f"{self.root}/{name}/manifest"
        if not _exists(self.spark, path):
            return None
        lines = self.spark.read.text(path).collect()
        return json.loads(lines[0][0]) if lines else None

    def load(self, name: str, settings: dict) -> DataFrame | None:
        """The table if it was made with exactly these settings."""
        if self.manifest(name) != json.loads(json.dumps(settings, sort_keys=True, default=str)):
            return None
        return self.spark.read.parquet(f"{self.root}/{name}/rows")

    def difference(self, name: str, settings: dict) -> list[str]:
        return settings_difference(self.manifest(name) or {}, json.loads(json.dumps(settings, sort_keys=True, default=str)))

    def clear(self, name: str) -> bool:
        path = f"{self.root}/{name}"
        if not _exists(self.spark, path):
            return False
        where, fs = _fs(self.spark, path)
        return fs.delete(where, True)

    def names(self) -> list[str]:
        """Tables whose manifest is there."""
        if not _exists(self.spark, self.root):
            return []
        where, fs = _fs(self.spark, self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory() and _exists(self.spark, f"{self.root}/{s.getPath().getName()}/manifest"))

    def clear_all(self) -> int:
        """Delete all tables; how many there were."""
        return sum(self.clear(n) for n in self.names())

    def get(self, name: str, settings: dict, make: Callable[[], DataFrame]) -> DataFrame:
        """The table made with these settings; it is made and kept where there is none."""
        kept = self.load(name, settings)
        return kept if kept is not None else self.save(name, make(), settings)


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    where, fs = _fs(spark, path)
    return fs.exists(where)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    where, fs = _fs(spark, old)
    if not fs.rename(where, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"cannot rename {old} to {new}")
