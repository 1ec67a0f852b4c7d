"""Where results go: Parquet by dataset and report, CSV on request."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Seconds that a saved table is kept, and that a replaced one is, for readers that have begun.
KEPT_SECONDS, GRACE_SECONDS = 86_400, 3_600


@dataclass(frozen=True)
class Version:
    path: str
    saved: float
    expires: float | None


class DatasetStore:
    """Raw and healed tables and reports under one folder that the cluster shares: <root>/<kind>/<dataset>.

    Each save writes a folder of its own and then a manifest that names it, by renaming a finished file; the newest manifest that has not
    expired is the table. A save that fails, or that reads the version it replaces, leaves that as it is. ``expire`` removes what has
    expired or was replaced long enough ago. Works in any store that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str, *, kept: float | None = KEPT_SECONDS, grace: float = GRACE_SECONDS):
        self.spark, self.root, self.kept, self.grace = spark, root.rstrip("/"), kept, grace

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def folder(self, kind: str, dataset: str) -> str:
        return f"{self.root}/{kind}/{dataset}"

    def versions(self, kind: str, dataset: str) -> list[Version]:
        """Those with a manifest, the newest first, expired ones too."""
        fs, at = self._at(self.folder(kind, dataset))
        if not fs.exists(at):
            return []
        found = []
        for f in fs.listStatus(at):
            if f.getPath().getName().startswith("manifest-"):
                stream = fs.open(f.getPath())
                try:
                    found.append(Version(**json.loads(bytes(stream.readAllBytes()))))
                finally:
                    stream.close()
        return sorted(found, key=lambda v: v.saved, reverse=True)

    def path(self, kind: str, dataset: str, now: float | None = None) -> str:
        """The folder of the newest version that has not expired."""
        newest = next(iter(self.versions(kind, dataset)), None)
        if newest is None or newest.expires is not None and newest.expires <= (now or time.time()):
            raise FileNotFoundError(f"no {kind} of {dataset}")
        return newest.path

    def save(self, kind: str, dataset: str, df: DataFrame) -> DataFrame:
        """Written whole or not at all; what is returned is read from there."""
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.folder(kind, dataset)}/version-{name}"
        df.write.parquet(path)
        saved = time.time()
        fs, part = self._at(f"{self.folder(kind, dataset)}/_manifest-{name}")
        stream = fs.create(part, False)
        try:
            stream.write(json.dumps({"path": path, "saved": saved, "expires": saved + self.kept if self.kept is not None else None}).encode())
        finally:
            stream.close()
        if not fs.rename(part, self._at(f"{self.folder(kind, dataset)}/manifest-{name}.json")[1]):
            raise OSError(f"{path} was written, but could not be made current")
        return self.spark.read.parquet(path)

    def load(self, kind: str, dataset: str) -> DataFrame:
        return self.spark.read.parquet(self.path(kind, dataset))

    def expire(self, kind: str, dataset: str, now: float | None = None) -> list[str]:
        """Removes versions that have expired, or were replaced over ``grace`` seconds ago, and folders as old that no manifest names
        (of saves that failed). Returns what has gone."""
        now = now or time.time()
        fs, at = self._at(self.folder(kind, dataset))
        versions = self.versions(kind, dataset)
        newer = [None, *(v.saved for v in versions)]  # when each was replaced
        gone = [v.path for v, replaced in zip(versions, newer, strict=False) if v.expires is not None and v.expires <= now or replaced is not None and replaced + self.grace <= now]
        known = {v.path.rpartition("/")[2] for v in versions}
        for f in fs.listStatus(at) if fs.exists(at) else []:
            name = f.getPath().getName()
            if name.startswith("version-") and name not in known and f.getModificationTime() / 1000 + self.grace <= now:
                gone.append(f"{self.folder(kind, dataset)}/{name}")
        for path in gone:  # the manifest first: a table is never half there
            name = path.rpartition("/version-")[2]
            fs.delete(self._at(f"{self.folder(kind, dataset)}/manifest-{name}.json")[1], False)
            fs.delete(self._at(path)[1], True)
        return gone

    def save_reports(self, dataset: str, reports: dict[str, DataFrame]) -> None:
        for name, df in reports.items():
            self.save(f"reports/{name}", dataset, df)


def write_csv(df: DataFrame, path: str, *, one_file: bool = False) -> None:
    """UTF-8 with a header. One file means one task, so it is only made when asked for."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)
