"""Stored feature tables: versioned by parameters, guarded on every read."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

LOGIC_VERSION = 1

Check = Callable[[DataFrame], Any]


def params_version(params: Mapping[str, Any]) -> str:
    """Short hash of the parameters and of the logic version."""
    text = json.dumps({"logic": LOGIC_VERSION, **params}, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def inputs_version(*tables: DataFrame) -> str:
    """Short hash of the files behind some tables: new or rewritten files give another one."""
    files = sorted({f for t in tables for f in t.inputFiles()})
    return hashlib.sha256("\n".join(files).encode()).hexdigest()[:12]


class FeatureTableStore:
    """Tables under ``root/name/v=<version>`` with a one-row manifest beside the data.

    Every build goes to a folder of its own. The manifest names it and is written
    last, after the stored data passed its guards, so a half-written or unchecked
    table is never mistaken for a finished one and a rebuild leaves the old data
    readable until it is published.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str, params: Mapping[str, Any]) -> str:
        return f"{self.root}/{name}/v={params_version(params)}"

    def manifest(self, name: str, params: Mapping[str, Any]) -> dict[str, Any] | None:
        """The manifest row, or None when this version was never completed."""
        try:
            row = self.spark.read.json(f"{self.path(name, params)}/manifest").first()
        except AnalysisException:
            return None
        return row.asDict() if row else None

    def write(
        self, name: str, params: Mapping[str, Any], df: DataFrame, check: Check | None = None
    ) -> DataFrame:
        path = self.path(name, params)
        folder = f"data-{uuid.uuid4().hex}"
        df.write.mode("error").parquet(f"{path}/{folder}")
        stored = self.spark.read.schema(df.schema).parquet(f"{path}/{folder}")
        if check:
            check(stored)
        row = {
            "name": name,
            "version": params_version(params),
            "params": json.dumps(dict(params), sort_keys=True, default=str),
            "columns": json.dumps(df.columns),
            "folder": folder,
        }
        self.spark.createDataFrame(
            [tuple(row.values())], ", ".join(f"{k} string" for k in row)
        ).write.mode("overwrite").json(f"{path}/manifest")
        return stored

    def read(
        self, name: str, params: Mapping[str, Any], check: Check | None = None
    ) -> DataFrame | None:
        """A finished table of exactly this version; guards run again on it."""
        found = self.manifest(name, params)
        if found is None:
            return None
        stored = self.spark.read.parquet(f"{self.path(name, params)}/{found['folder']}")
        if check:
            check(stored)
        return stored

    def get_or_build(
        self,
        name: str,
        params: Mapping[str, Any],
        build: Callable[[], DataFrame],
        *,
        check: Check | None = None,
        columns: list[str] | None = None,
        force: bool = False,
    ) -> DataFrame:
        """Reuse a current table; rebuild when missing, unversioned or of another shape."""
        if not force:
            stored = self.read(name, params, check)
            if stored is not None and (columns is None or set(columns) <= set(stored.columns)):
                return stored
        return self.write(name, params, build(), check)
