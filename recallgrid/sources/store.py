"""Tables that are written: every write is a new version in a folder of its own, which a rename makes the current one.

A failed or repeated write leaves the current version as it was, and readers keep the version they began with. Checks come
before the write, as joins; what they refuse is an error that names how many rows and one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.functions.checks import space_problem
from recallgrid.operators.lifecycle import inserted_once, upserted


class Store:
    """The tables under one folder, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        at = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def names(self) -> list[str]:
        """Tables that have a version."""
        at = self._path(self.folder)
        found = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(n for n in found if self._versions(n))

    def read(self, name: str, empty: str | None = None) -> DataFrame:
        """The current version; without one, no rows of the schema ``empty``."""
        versions = self._versions(name)
        if not versions and empty:
            return self.spark.createDataFrame([], empty)
        if not versions:
            raise ValueError(f"no table {name}")
        return self.spark.read.parquet(f"{self.folder}/{name}/v{versions[-1]}")

    def write(self, name: str, rows: DataFrame) -> None:
        """Makes ``rows`` the current version; of two writers one fails, as both rename to the same version."""
        version = (self._versions(name) or [0])[-1] + 1
        made = f"{self.folder}/{name}/.making-{version}-{rows.sparkSession.sparkContext.applicationId}"
        rows.write.mode("overwrite").parquet(made)
        target = self._path(f"{self.folder}/{name}/v{version}")
        if self._fs.exists(target) or not self._fs.rename(self._path(made), target):
            self._fs.delete(self._path(made), True)
            raise RuntimeError(f"another writer made version {version} of {name}")

    # Sinks

    def append_events(self, events: DataFrame, memories: DataFrame) -> None:
        """Appends events; every one that names a memory must name one of its own tenant."""
        refused(foreign_targets(events, memories, "memory_id"), "events of unknown or other tenants' memories")
        old = self.read("memory_events", events.schema.simpleString()) if not self._versions("memory_events") else self.read("memory_events")
        self.write("memory_events", old.unionByName(events) if self._versions("memory_events") else events)

    def append_relations(self, relations: DataFrame, memories: DataFrame) -> None:
        """Appends relations whose key isn't there; both ends must be memories of the relation's tenant."""
        for end in ("from_id", "to_id"):
            refused(foreign_targets(relations, memories, end), f"relations with an unknown {end}")
        keys = ["tenant_id", "from_id", "to_id"]
        if self._versions("relations"):
            old = self.read("relations")
            self.write("relations", old.unionByName(inserted_once(relations, old, keys)))
        else:
            self.write("relations", relations.dropDuplicates(keys))

    def upsert_vectors(self, space: str, rows: DataFrame, memories: DataFrame) -> None:
        """The last write of each (tenant, memory) of a registered space wins; values are rounded to 4 bytes, unknown memories refused."""
        if space not in self.spaces():
            raise ValueError(f"space {space} isn't registered")
        refused(foreign_targets(rows, memories, "memory_id"), "vectors of unknown memories")
        new = stored_vectors(rows)
        name = f"vectors-{space}"
        self.write(name, upserted(self.read(name), new, ["tenant_id", "memory_id"], "created_at") if self._versions(name) else upserted(new, new.limit(0), ["tenant_id", "memory_id"], "created_at"))

    def upsert_settings(self, rows: DataFrame) -> None:
        """Of each tenant the new row replaces the old one."""
        new = rows.dropDuplicates(["tenant_id"])
        old = self.read("tenant_settings") if self._versions("tenant_settings") else new.limit(0)
        self.write("tenant_settings", old.join(new.select("tenant_id"), "tenant_id", "left_anti").unionByName(new))

    def delete_vectors(self, keys: DataFrame) -> None:
        """Deletes ``(tenant_id, memory_id)`` from every space."""
        for space in self.spaces():
            if self._versions(name := f"vectors-{space}"):
                self.write(name, self.read(name).join(keys.select("tenant_id", "memory_id").distinct(), ["tenant_id", "memory_id"], "left_anti"))

    def purge_memories(self, keys: DataFrame) -> None:
        """Purges ``(tenant_id, memory_id)``: vectors of every space and relations at either end go first, then the memories' texts; keys, subject and hash stay.

        Each step can be done again, so a purge that broke off is finished by a second one.
        """
        keys = keys.select("tenant_id", F.lower("memory_id").alias("memory_id")).distinct()
        self.delete_vectors(keys)
        if self._versions("relations"):
            rows = self.read("relations")
            for end in ("from_id", "to_id"):
                rows = rows.join(keys.select("tenant_id", F.col("memory_id").alias(end)), ["tenant_id", end], "left_anti")
            self.write("relations", rows)
        rows = self.read("memories")
        gone = keys.select("tenant_id", F.col("memory_id").alias("id"), F.lit(True).alias("_gone"))
        empty = {c: F.when(F.col("_gone"), F.lit("")).otherwise(F.col(c)).alias(c) for c in ("content", "digest")} | {"status": F.when(F.col("_gone"), "forgotten").otherwise(F.col("status")).alias("status")}
        self.write("memories", rows.join(gone, ["tenant_id", "id"], "left").select(*[empty.get(c, F.col(c)) for c in rows.columns]))

    def erase_tenant(self, tenant: str) -> dict[str, int]:
        """Deletes a tenant from every table that has the column, dependent tables first; rows deleted by table."""
        order = sorted(self.names(), key=lambda n: (n == "memories", n == "observations", n == "tenant_settings", n))
        out = {}
        for name in order:
            rows = self.read(name)
            if "tenant_id" in rows.columns:
                out[name] = rows.where(F.col("tenant_id") == tenant).count()
                if out[name]:
                    self.write(name, rows.where(~F.col("tenant_id").eqNullSafe(tenant)))
        return out

    # Catalog of embedding spaces

    def spaces(self) -> dict[str, int]:
        """Registered spaces with their dimensions."""
        return {r.space: r.dimensions for r in self.read("spaces", "space string, dimensions int").collect()}  # one row a space

    def register_space(self, space: str, dimensions: int) -> None:
        """Registers a space once; again with the same dimensions changes nothing, with others is an error."""
        if problem := space_problem(space, dimensions):
            raise ValueError(problem)
        known = self.spaces()
        if space in known and known[space] != dimensions:
            raise ValueError(f"space {space} has {known[space]} dimensions")
        if space not in known:
            self.write("spaces", self.spark.createDataFrame([*known.items(), (space, dimensions)], "space string, dimensions int"))


def foreign_targets(rows: DataFrame, memories: DataFrame, key: str) -> DataFrame:
    """Rows whose memory isn't there or is another tenant's; a null key names none and is no fault."""
    own = memories.select("tenant_id", F.lower("id").alias("_id")).distinct()
    return rows.where(F.col(key).isNotNull()).withColumn("_id", F.lower(key)).join(own, ["tenant_id", "_id"], "left_anti").drop("_id")


def with_ownership(rows: DataFrame, memories: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``owned``: a left join, so that no row is lost."""
    own = memories.select("tenant_id", F.lower("id").alias("_id"), F.lit(True).alias("owned")).distinct()
    return rows.withColumn("_id", F.lower(key)).join(own, ["tenant_id", "_id"], "left").withColumn("owned", F.coalesce("owned", F.lit(False))).drop("_id")


def refused(rows: DataFrame, what: str) -> None:
    found = rows.limit(1).collect()
    if found:
        raise ValueError(f"{rows.count()} {what}, such as {found[0].asDict()}")


def stored_vectors(rows: DataFrame) -> DataFrame:
    """Vectors as they are stored: 4-byte floats."""
    return rows.withColumn("embedding", F.col("embedding").cast("array<float>"))


def recorded_responses(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(request_hash, response)`` of a file of JSON lines with recorded answers of a service; of repeated requests the last line counts."""
    lines = spark.read.json(path, schema="request string, response string, seq bigint")
    return lines.groupBy(F.sha2("request", 256).alias("request_hash")).agg(F.max_by("response", "seq").alias("response"))


def answered(requests: DataFrame, responses: DataFrame, column: str = "request") -> DataFrame:
    """``requests`` with their recorded ``response``; null where none was recorded."""
    return requests.withColumn("request_hash", F.sha2(column, 256)).join(responses, "request_hash", "left").drop("request_hash")
