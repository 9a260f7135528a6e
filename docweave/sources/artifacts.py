"""Sinks, content-addressed artifacts, and an object store on a shared folder.

Tables go out in parallel, one file per partition; only small reports of a run are single files written by the driver.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical_json import canonical_json


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Parquet, JSON, CSV or text. CSV takes flat columns only; arrays of strings are joined by commas first."""
    if kind == "csv":
        df = df.select(*[F.array_join(c, ",").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes])
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    {"parquet": w.parquet, "json": w.json, "csv": lambda p: w.option("header", True).csv(p), "text": w.text}[kind](path)


def flatten_context(selected: DataFrame) -> DataFrame:
    """One row per community and chunk; the ids of a chunk's parents joined by commas."""
    return selected.select("scope", "community", F.explode("chunks").alias("c")).select("scope", "community", "c.chunk_uid", F.array_join("c.parents", ",").alias("parents"))


def graph_rows(edges: DataFrame) -> DataFrame:
    """(document_id, body): every document's edges as one JSON text, in order."""
    item = F.struct("i", "j", F.round("sim", 9).alias("sim"))
    return edges.groupBy("document_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("body"))


def graph_edges(rows: DataFrame) -> DataFrame:
    shape = "array<struct<i:string,j:string,sim:double>>"
    return rows.select("document_id", F.explode(F.from_json("body", shape)).alias("e")).select("document_id", "e.i", "e.j", "e.sim")


#: What a claim says of an artifact besides its place and digest.
CLAIM = ("generation", "fingerprint", "attempt", "fence")


class ArtifactStore:
    """Write-once tables below ``root``, one folder per document and version, each with its digest.

    Writing the same rows again does nothing; writing other rows under a taken version is refused. A folder becomes visible
    by a rename, so a job that dies leaves no half-written version.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jvm.java.net.URI(self.root if ":" in self.root else "file://" + self.root), spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def folder(self, collection: str, document: str, version: int) -> str:
        from urllib.parse import quote

        return f"{self.root}/graphs/{quote(collection, safe='-_.~')}/{quote(document, safe='-_.~')}/v{version}"

    def digest_of(self, df: DataFrame) -> str:
        """SHA-256 over the row digests in order: independent of partitions, and nothing but 64 characters a row is collected by the executors."""
        row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
        # sums of digest parts commute, so rows need no order and no single place
        parts = [F.sum(F.conv(F.substring("d", 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")) for k in range(5)]
        sums = df.select(row.alias("d")).agg(F.count(F.lit(1)), *parts).first()
        return hashlib.sha256(canonical_json([str(x) for x in sums]).encode()).hexdigest()

    def write(self, df: DataFrame, collection: str, document: str, version: int, claim: dict | None = None) -> str:
        """The digest of what stands under the version now. ``claim`` (generation, fingerprint, attempt, fence) is kept beside the rows for readers to check."""
        final, d = self.folder(collection, document, version), self.digest_of(df)
        if self._fs.exists(self._path(final)):
            if self.digest_of(self.spark.read.parquet(f"{final}/data")) != d:
                raise FileExistsError(f"version {version} of {document} holds other rows")
            return d
        temporary = f"{final}.{d[:12]}.writing"
        df.write.mode("overwrite").parquet(f"{temporary}/data")
        told = {"collection": collection, "document": document, "version": version, "digest": d} | {k: (claim or {}).get(k) for k in CLAIM}
        self.spark.createDataFrame([(canonical_json(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{temporary}/claim")
        self._fs.mkdirs(self._path(final).getParent())
        if not self._fs.rename(self._path(temporary), self._path(final)):
            raise OSError(f"could not publish {final}")
        return d

    def read(self, collection: str, document: str, version: int, digest: str | None = None, claim: dict | None = None) -> DataFrame:
        """The rows, once everything said of them holds: that they are this collection's, document's and version's, made under this claim (generation, fingerprint,
        attempt, fence, as far as named), and that their digest is the stored and the expected one."""
        folder = self.folder(collection, document, version)
        df = self.spark.read.parquet(f"{folder}/data")
        if digest is None and claim is None:
            return df
        told = json.loads("".join(r[0] for r in self.spark.read.text(f"{folder}/claim").collect()))
        wanted = {"collection": collection, "document": document, "version": version} | (claim or {}) | ({"digest": digest} if digest else {})
        for k, v in wanted.items():
            if told.get(k) != v:
                raise ValueError(f"the artifact's {k} differs from the expected one")
        if self.digest_of(df) != told["digest"]:
            raise ValueError("the artifact's digest differs from the stored one")
        return df


class ObjectStore:
    """Small control objects by key, with conditional writes and fences that only grow.

    Every write is a new revision of its key, made by a link that fails if the revision is there. So of two writers that
    saw the same state one wins and the other is told, on every file system that all of them share. A seam: this one lives in a folder.
    """

    def __init__(self, root: str):
        self.root = Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    def _folder(self, key: str) -> Path:
        path = (self.root / (key + ".revisions")).resolve()
        if self.root.resolve() not in path.parents:
            raise ValueError("the key leaves the store")
        return path

    def _last(self, key: str) -> tuple[int, bytes]:
        numbers = sorted(int(p.name) for p in self._folder(key).glob("[0-9]*") if p.name.isdigit())
        return (numbers[-1], (self._folder(key) / f"{numbers[-1]:012d}").read_bytes()) if numbers else (0, b"")

    def _add(self, key: str, revision: int, body: bytes) -> None:
        folder = self._folder(key)
        folder.mkdir(parents=True, exist_ok=True)
        temporary = folder / f"writing-{uuid.uuid4().hex}"
        temporary.write_bytes(body)
        try:
            os.link(temporary, folder / f"{revision:012d}")
        except FileExistsError:
            raise FileExistsError("the object has changed") from None
        finally:
            temporary.unlink()

    def get(self, key: str) -> tuple[dict, str] | None:
        body = self._last(key)[1]
        return (json.loads(body), hashlib.sha256(body).hexdigest()) if body else None

    def put(self, key: str, value: dict, if_match: str | None = None, if_none: bool = False) -> str:
        revision, body = self._last(key)
        tag = hashlib.sha256(body).hexdigest() if body else None
        if if_none and tag or if_match is not None and if_match != tag:
            raise FileExistsError("the object has changed")
        if body and value.get("fence", 0) < json.loads(body).get("fence", 0):
            raise ValueError("the fence is older than the object's")
        new = canonical_json(value).encode()
        self._add(key, revision + 1, new)
        return hashlib.sha256(new).hexdigest()

    def delete(self, key: str) -> None:
        """An empty revision: the object is gone, its number is not used again."""
        revision, body = self._last(key)
        if body:
            self._add(key, revision + 1, b"")
