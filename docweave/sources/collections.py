"""Collections of points: tables in a folder, partitioned by document, with a mode that is pinned once.

A collection is a folder with a ``points`` table and a small file of properties. Creating one is idempotent; its mode is bound by the first
run that changes it and never changes, so that runs of the other kind are refused instead of mixing rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MODES = ("document-safe", "legacy-vector")


class Collection:
    """``folder`` may lie in any file system Spark can reach; properties are created by rename-free exclusive creation, so one of two first runs wins."""

    def __init__(self, spark: SparkSession, folder: str, partition_by: str = "document_id"):
        self.spark, self.folder, self.partition_by = spark, folder.rstrip("/"), partition_by
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs, self._path = path.getFileSystem(spark._jsc.hadoopConfiguration()), lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)

    def exists(self) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/points"))

    def create(self, schema: StructType) -> bool:
        """An empty table of the schema; False if there is one already. Partitions by document and the files' statistics are its index."""
        if self.exists():
            return False
        self.spark.createDataFrame([], schema).write.partitionBy(self.partition_by).parquet(f"{self.folder}/points")
        self._write("schema.json", schema.json())
        return True

    def read(self, mode: str | None = None) -> DataFrame:
        """The points. A reader that names the mode it can read is refused the other one."""
        pinned = self.mode()
        if mode is not None and pinned is not None and pinned != mode:
            raise PermissionError(f"the collection is {pinned}, the reader {mode}")
        schema = StructType.fromJson(json.loads(self._read("schema.json")))
        return self.spark.read.schema(schema).parquet(f"{self.folder}/points").select(*schema.names)

    def append(self, rows: DataFrame, mode: str) -> None:
        """Adds rows after the mode is bound. Documents that are there already are refused as a whole."""
        self.bind(mode)
        known = rows.select(self.partition_by).distinct().join(self.read().select(self.partition_by).distinct(), self.partition_by, "left_semi")
        if not known.isEmpty():
            raise ValueError(f"{known.first()[0]!r} is in the collection; replace the document")
        rows.repartition(F.col(self.partition_by)).write.mode("append").partitionBy(self.partition_by).parquet(f"{self.folder}/points")

    def mode(self) -> str | None:
        return json.loads(self._read("mode.json"))["mode"] if self._fs.exists(self._path(f"{self.folder}/mode.json")) else None

    def bind(self, mode: str) -> str:
        """Pins the mode if none is; raises where another one is pinned."""
        if mode not in MODES:
            raise ValueError(f"the mode must be one of {', '.join(MODES)}")
        if self.mode() is None:
            try:
                self._write("mode.json", json.dumps({"mode": mode}))
            except Exception:
                if self.mode() is None:
                    raise
        if self.mode() != mode:
            raise PermissionError(f"the collection is bound to {self.mode()}")
        return mode

    def _write(self, name: str, text: str) -> None:
        # without overwrite: creation fails if another run was first
        out = self._fs.create(self._path(f"{self.folder}/{name}"), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _read(self, name: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(f"{self.folder}/{name}", wholetext=True).collect())


def evidence_source(selected: DataFrame | None, raw: DataFrame) -> DataFrame:
    """The selected evidence where a selection was made, even an empty one, else what was retrieved."""
    return raw if selected is None else selected


def empty_graph(spark: SparkSession) -> dict[str, DataFrame]:
    """The parts of a document graph without rows, for a run that has none: readers never meet a missing part."""
    shapes = {
        "edges": "document_id string, i string, j string, sim double", "communities": "document_id string, node string, community string", "entities": "document_id string, canonical string, mention_count bigint, support string, isolated_noise_candidate boolean",
        "relations": "document_id string, src string, dst string, weight double, evidence_count bigint, n_support bigint", "mentions": "document_id string, chunk_uid string, entity string, weight double",
        "candidates": "document_id string, head string, tail string, support_chunk_uids array<string>, triggers array<string>, reason string", "diagnostics": "document_id string, source string, status string, n bigint",
    }
    return {k: spark.createDataFrame([], v) for k, v in shapes.items()}
