"""Saved indexes: immutable segments in levels, tombstones and a manifest.

    root/segments/<id>/docs, root/segments/<id>/postings     parquet, each file of postings sorted by (field_idx, term, doc_id)
    root/tombstones/<id>                                     (doc_id, segments up to this number are meant)
    root/manifest/<version>                                  one JSON file; the largest version counts

Every path goes through Spark, so any file system that Spark knows will do. A writer first writes data, then a manifest:
a crash leaves unreferenced files and the state before. When a level has segments_per_level segments they are merged into
one of the next level; merging drops deleted documents and recounts everything.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QuillError
from ..operators.index import Index, IndexSpec, build_index

#: Row groups of postings: small, so that a query's terms prune most of a file.
BLOCK_BYTES = 4 << 20


def working_root(spark: SparkSession) -> str:
    """A folder that driver and executors share: that of spark.checkpoint.dir; on one machine a temporary one, if it is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise QuillError("spark.checkpoint.dir must name a shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="sparkquill-")
    return f"{base.rstrip('/')}/index-{uuid.uuid4().hex}"


class IndexStore:
    def __init__(self, spark: SparkSession, root: str, spec: IndexSpec):
        self.spark, self.root, self.spec = spark, root.rstrip("/"), spec
        self.manifest = self._read_manifest()

    # ---- manifest

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _read_manifest(self) -> dict:
        fs, at = self._fs(), self._path("manifest")
        if not fs.exists(at):
            return {"version": 0, "next": 0, "segments": [], "tombstones": []}
        versions = [int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()]
        for v in sorted(versions, reverse=True):
            lines = [r[0] for r in self.spark.read.text(f"{self.root}/manifest/{v}").collect()]
            try:
                return json.loads("\n".join(lines))
            except ValueError:  # another writer is about to write it
                continue
        return {"version": 0, "next": 0, "segments": [], "tombstones": []}

    def _commit(self, manifest: dict) -> None:
        """Publish: the file of the next version is created, which only one writer can do; another one fails here."""
        from py4j.protocol import Py4JJavaError

        manifest = {**manifest, "version": self.manifest["version"] + 1}
        fs, data = self._fs(), bytearray(json.dumps(manifest).encode())
        fs.mkdirs(self._path("manifest"))
        try:
            out = fs.create(self._path(f"manifest/{manifest['version']}"), False)
        except Py4JJavaError as e:
            if "exist" not in str(e.java_exception):
                raise
            raise QuillError("another writer has changed the index") from e
        out.write(data)
        out.close()
        self.manifest = manifest

    # ---- reading

    def segment(self, name: str) -> Index:
        base = f"{self.root}/segments/{name}"
        return Index(self.spec, self.spark.read.parquet(f"{base}/docs"), self.spark.read.parquet(f"{base}/postings"))

    def _dead(self) -> DataFrame | None:
        out = None
        for t in self.manifest["tombstones"]:
            d = self.spark.read.parquet(f"{self.root}/tombstones/{t['id']}").select("doc_id", F.lit(t["before"]).alias("before"))
            out = d if out is None else out.unionByName(d)
        return None if out is None else out.groupBy("doc_id").agg(F.max("before").alias("before"))

    def _live(self, df: DataFrame, number: int, dead: DataFrame | None) -> DataFrame:
        return df if dead is None else df.join(dead.where(F.col("before") > number).select("doc_id"), "doc_id", "left_anti")

    def open(self, documents: DataFrame | None = None) -> Index:
        """The index of all live documents."""
        out, dead = None, self._dead()
        for s in self.manifest["segments"]:
            part = self.segment(s["id"])
            part = Index(self.spec, self._live(part.docs, s["number"], dead), self._live(part.postings, s["number"], dead))
            out = part if out is None else out.plus(part)
        if out is None:
            raise QuillError("the index has no segment")
        out.documents = documents
        return out

    # ---- writing

    def _write(self, index: Index) -> dict:
        number = self.manifest["next"]
        name = f"{number:08d}-{uuid.uuid4().hex[:8]}"
        base = f"{self.root}/segments/{name}"
        index.docs.write.parquet(f"{base}/docs")
        by = [*index.part, "field_idx", "term"]
        # each file is sorted by itself and has all terms of its documents: postings stay where their texts lie
        index.postings.sortWithinPartitions(*by, "doc_id").write.option("parquet.block.size", BLOCK_BYTES).parquet(f"{base}/postings")
        return {"id": name, "number": number, "level": 0, "docs": self.spark.read.parquet(f"{base}/docs").select("doc_id").distinct().count()}

    def append(self, df: DataFrame) -> dict:
        """Index the rows as a new segment (a spill). Documents that exist already are replaced. Returns the segment."""
        return self.add(build_index(df, self.spec), df.select(F.col(self.spec.id_col).alias("doc_id")))

    def add(self, index: Index, ids: DataFrame | None = None) -> dict:
        seg = self._write(index)
        manifest = {**self.manifest, "next": self.manifest["next"] + 1, "segments": [*self.manifest["segments"], seg]}
        if ids is not None and self.manifest["segments"]:
            manifest["tombstones"] = [*self.manifest["tombstones"], self._bury(ids, seg["number"])]
        self._commit(manifest)
        self.compact()
        return seg

    def _bury(self, ids: DataFrame, before: int) -> dict:
        name = uuid.uuid4().hex
        ids.select("doc_id").distinct().write.parquet(f"{self.root}/tombstones/{name}")
        return {"id": name, "before": before}

    def delete(self, ids: DataFrame) -> None:
        """Hide documents (first column: ids) of all present segments."""
        grave = self._bury(ids.select(F.col(ids.columns[0]).alias("doc_id")), self.manifest["next"])
        self._commit({**self.manifest, "tombstones": [*self.manifest["tombstones"], grave]})

    def _merge(self, segments: list[dict], level: int) -> None:
        dead, merged = self._dead(), None
        for s in segments:
            part = self.segment(s["id"])
            part = Index(self.spec, self._live(part.docs, s["number"], dead), self._live(part.postings, s["number"], dead))
            merged = part if merged is None else merged.plus(part)
        seg = {**self._write(merged), "level": level}
        gone = {s["id"] for s in segments}
        rest = [s for s in self.manifest["segments"] if s["id"] not in gone]
        # the merged segment keeps the largest number of its sources, so that later tombstones still meet it
        seg["number"] = max(s["number"] for s in segments)
        manifest = {**self.manifest, "next": self.manifest["next"] + 1, "segments": sorted([*rest, seg], key=lambda s: s["number"])}
        # the merged segment has left deleted documents out; a tombstone stays while another segment may still hold some
        manifest["tombstones"] = [t for t in self.manifest["tombstones"] if any(s["number"] < t["before"] for s in rest)]
        self._commit(manifest)

    def compact(self) -> int:
        """Merge full levels, from the lowest up; how many merges there were."""
        done = 0
        while True:
            levels: dict[int, list[dict]] = {}
            for s in self.manifest["segments"]:
                levels.setdefault(s["level"], []).append(s)
            full = next((n for n in sorted(levels) if len(levels[n]) >= self.spec.conf.segments_per_level), None)
            if full is None:
                return done
            self._merge(levels[full], full + 1)
            done += 1

    def force_merge(self) -> None:
        """One segment of all live documents."""
        if self.manifest["segments"]:
            self._merge(self.manifest["segments"], max(s["level"] for s in self.manifest["segments"]) + 1)

    def vacuum(self) -> DataFrame:
        """Force a merge, remove files that no manifest refers to, and return (n_docs, n_segments)."""
        self.force_merge()
        fs = self._fs()
        for folder, live in (("segments", {s["id"] for s in self.manifest["segments"]}), ("tombstones", {t["id"] for t in self.manifest["tombstones"]})):
            if fs.exists(self._path(folder)):
                for s in fs.listStatus(self._path(folder)):
                    if s.getPath().getName() not in live:
                        fs.delete(s.getPath(), True)
        n = sum(s["docs"] for s in self.manifest["segments"])
        return self.spark.createDataFrame([(n, len(self.manifest["segments"]))], "n_docs long, n_segments int")

    def memory_usage(self) -> DataFrame:
        """(segment, level, n_docs, size_bytes) of each segment."""
        fs = self._fs()
        rows = [(s["id"], s["level"], s["docs"], fs.getContentSummary(self._path(f"segments/{s['id']}")).getLength()) for s in self.manifest["segments"]]
        return self.spark.createDataFrame(rows, "segment string, level int, n_docs long, size_bytes long")
