"""Snapshot tables on shared storage.

Every refresh appends its rows under a new version and then writes one small heads table
that names the current version of every tenant. Writing the heads is the commit: readers
see both tables of a refresh, or neither. Other tenants' rows are never rewritten, and a
tenant whose refresh found nothing simply points at a version without rows. A commit removes
what no head names any more, so a store does not grow with the number of refreshes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsburst.schemas import LONG, TEXT, TIME, table
from newsburst.session import file_system

TABLES = ("snapshot", "event_articles")
# The schemas of both tables ride along, so that readers need not infer them.
HEADS = table(system_id=LONG, version=TEXT, snapshot_time=TIME, snapshot=TEXT, event_articles=TEXT)


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _committed(self) -> list[int]:
        """Numbers of finished heads tables, of which ``commit`` leaves the last two: a finished
        write leaves a _SUCCESS file."""
        system, path = file_system(self.spark, f"{self.path}/heads/n=*/_SUCCESS")
        found = system.globStatus(path) or []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    def heads(self) -> DataFrame:
        numbers = self._committed()
        if not numbers:
            return self.spark.createDataFrame([], HEADS)
        return self.spark.read.schema(HEADS).parquet(f"{self.path}/heads/n={numbers[-1]}")

    def commit(
        self, snapshot: DataFrame, event_articles: DataFrame, tenants: DataFrame, snapshot_time,
        keep: int = 1,
    ) -> str:
        """Store a refresh of ``tenants``; each keeps its last ``keep`` versions.

        Expects one writer at a time, as one refresh schedule per store gives.
        """
        version = uuid.uuid4().hex
        kinds = {}
        for name, rows in zip(TABLES, (snapshot, event_articles)):
            rows.write.parquet(f"{self.path}/{name}/version={version}")
            kinds[name] = rows.schema.json()
        refreshed = tenants.select("system_id").distinct()
        new = refreshed.select(
            "system_id",
            F.lit(version).alias("version"),
            snapshot_time.cast("timestamp").alias("snapshot_time"),
            *(F.lit(kind).alias(name) for name, kind in kinds.items()),
        )
        old = self.heads()
        if keep <= 1:
            old = old.join(refreshed, "system_id", "left_anti")
        else:
            ranked = F.sort_array(F.collect_list(F.struct("snapshot_time", "version", *TABLES)), asc=False)
            others = old.join(refreshed, "system_id", "left_anti")
            recent = (
                old.join(refreshed, "system_id", "left_semi")
                .groupBy("system_id")
                .agg(F.slice(ranked, 1, keep - 1).alias("kept"))
                .select("system_id", F.inline("kept"))
                .select(*HEADS.names)
            )
            old = others.unionByName(recent)
        numbers = self._committed()
        following = numbers[-1] + 1 if numbers else 1
        old.unionByName(new).coalesce(1).write.parquet(f"{self.path}/heads/n={following}")
        self._clean([n for n in numbers if n < following - 1])
        return version

    def _names(self, heads: DataFrame) -> list[str]:
        """Versions that heads name: at most one per tenant and kept snapshot."""
        return sorted(r.version for r in heads.select("version").distinct().collect())

    def _clean(self, old: list[int]) -> None:
        """Remove heads older than the one before the current, for its readers may still be at
        work, and versions that neither names."""
        for n in old:
            system, path = file_system(self.spark, f"{self.path}/heads/n={n}")
            system.delete(path, True)
        named = set()
        for n in self._committed():
            named.update(self._names(self.spark.read.schema(HEADS).parquet(f"{self.path}/heads/n={n}")))
        for name in TABLES:
            system, path = file_system(self.spark, f"{self.path}/{name}/version=*")
            for found in system.globStatus(path) or []:
                if found.getPath().getName().split("=")[1] not in named:
                    system.delete(found.getPath(), True)

    def read(self, name: str) -> DataFrame:
        """Current rows of ``snapshot`` or ``event_articles``: only the folders that the heads
        name are listed and read."""
        heads = self.heads()
        kinds = heads.select("version", name).distinct().collect()
        if not kinds:
            raise LookupError(f"nothing was stored in {self.path} yet")
        schema = T.StructType.fromJson(json.loads(kinds[0][name]))
        folders = [f"{self.path}/{name}/version={k.version}" for k in kinds]
        rows = (
            self.spark.read.schema(T.StructType([*schema.fields, T.StructField("version", TEXT)]))
            .option("basePath", f"{self.path}/{name}")
            .parquet(*folders)
        )
        return rows.join(heads.select("system_id", "version"), ["system_id", "version"], "left_semi").drop("version")

    @property
    def snapshot(self) -> DataFrame:
        return self.read("snapshot")

    @property
    def event_articles(self) -> DataFrame:
        return self.read("event_articles")
