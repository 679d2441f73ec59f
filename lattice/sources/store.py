"""A store of Parquet tables under one folder: scans, appends, upserts, soft deletes, cascades.

Every method takes and returns DataFrames. Appends add files. Updates and deletes write the new state of a table beside the old one
and then move a small pointer file to it, so readers of the old state are not disturbed and a job that dies halfway
changes nothing. A temporary-view form for tests is a store over a temporary folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice import schemas
from lattice.operators import state


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _version(self, table: str) -> str:
        pointer = self._file(f"{table}/_current")
        if not self._fs.exists(pointer):
            return "v0"
        stream = self._fs.open(pointer)
        try:
            return str(stream.readUTF())
        finally:
            stream.close()

    def scan(self, table: str, where: Column | None = None) -> DataFrame:
        """All rows, or those of a predicate, which reaches the Parquet scan."""
        where_at = f"{self.path}/{table}/{self._version(table)}"
        kind = schemas.schema(table)
        df = self.spark.read.schema(kind).parquet(where_at) if self._fs.exists(self._file(f"{table}/{self._version(table)}")) else self.spark.createDataFrame([], kind)
        return df if where is None else df.where(where)

    def append(self, table: str, rows: DataFrame) -> DataFrame:
        """Appends rows, missing ids, flags, weights and times filled in; returns the ids."""
        full = self._filled(table, rows)
        full.write.mode("append").parquet(f"{self.path}/{table}/{self._version(table)}")
        return full.select(full.columns[0])

    def _filled(self, table: str, rows: DataFrame) -> DataFrame:
        defaults = {"is_archived": F.lit(False), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp(), "semantic_similarity": F.lit(0.0), "temporal_proximity": F.lit(0.0), "causal_weight": F.lit(0.0)}
        out = []
        for f in schemas.schema(table).fields:
            if f.name in rows.columns:
                c = F.col(f.name).cast(f.dataType)
                c = F.coalesce(c, defaults[f.name]) if f.name in defaults else c
            elif f.name == "id":
                c = F.md5(F.concat_ws("\x1f", *[F.to_json(F.struct(x)) for x in rows.columns]))  # the same rows get the same ids if a task is run again
            else:
                c = defaults.get(f.name, F.lit(None)).cast(f.dataType)
            out.append(c.alias(f.name))
        return rows.select(*out)

    def replace(self, table: str, rows: DataFrame) -> None:
        """Makes rows, which may read the table itself, its new state."""
        version = f"v-{uuid.uuid4().hex}"
        self._filled(table, rows).write.parquet(f"{self.path}/{table}/{version}")
        stream = self._fs.create(self._file(f"{table}/_current"), True)
        try:
            stream.writeUTF(version)
        finally:
            stream.close()

    def by_ids(self, table: str, ids: DataFrame, key: str = "id", archived: bool = False) -> DataFrame:
        """Rows of an id set (a column of the key's name); archived units only on demand."""
        rows = self.scan(table)
        if table == "units" and not archived:
            rows = rows.where(~F.col("is_archived"))
        return rows.join(ids.select(key).distinct(), key, "left_semi")

    def units_with_vectors(self, workspace: str) -> DataFrame:
        return self.scan("units", (F.col("workspace_id") == workspace) & F.col("embedding").isNotNull() & ~F.col("is_archived"))

    def workspace(self, workspace: str) -> DataFrame:
        return self.scan("workspaces", F.col("id") == workspace).limit(1)

    def edges_touching(self, workspace: str, ids: DataFrame) -> DataFrame:
        """Edges with either end among ids, once each."""
        e = self.scan("unit_edges", F.col("workspace_id") == workspace)
        wanted = ids.select(F.col("id").alias("_id")).distinct()
        return e.join(wanted, e["src"] == wanted["_id"], "left_semi").unionByName(e.join(wanted, e["dst"] == wanted["_id"], "left_semi")).dropDuplicates(["id"])

    def members(self, concept: str | None = None) -> DataFrame:
        """Units of a concept (or all: concept_id beside the unit's columns), archived ones left out."""
        m = self.scan("concept_members")
        m = m if concept is None else m.where(F.col("concept_id") == concept)
        return m.join(self.scan("units").where(~F.col("is_archived")), F.col("unit_id") == F.col("id")).drop("unit_id")

    def insert_if_absent(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        """Appends only rows whose keys the table lacks; repeats within rows count once."""
        self.append(table, rows.dropDuplicates(keys).join(self.scan(table).select(*keys), keys, "left_anti"))

    def archive(self, ids: DataFrame) -> None:
        """Marks units as archived."""
        units = self.scan("units")
        hit = ids.select(F.col("id"), F.lit(True).alias("_hit")).distinct()
        self.replace("units", units.join(hit, "id", "left").withColumn("is_archived", F.col("is_archived") | F.coalesce("_hit", F.lit(False))).drop("_hit"))

    def update(self, table: str, changes: DataFrame, key: str = "id") -> None:
        """Overwrites, by key, the columns that changes has (null leaves the old value), such as a concept's signature."""
        new = [c for c in changes.columns if c != key]
        joined = self.scan(table).join(changes.select(key, *[F.col(c).alias(f"_{c}") for c in new]), key, "left")
        self.replace(table, joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in new else c for c in schemas.schema(table).names]))

    def upsert(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        """One row for each key: the latest by updated_at, a new one before an old one of the same time."""
        self.replace(table, state.upsert(self.scan(table), self._filled(table, rows), keys, "updated_at"))

    def delete(self, table: str, ids: DataFrame, key: str = "id") -> None:
        """Deletes rows by key, and what belongs to them."""
        gone = ids.select(F.col(key).alias("_gone")).distinct()
        for child, column in schemas.PARENTS.get(table, []):
            rows = self.scan(child)
            doomed = rows.join(gone, rows[column] == gone["_gone"], "left_semi")
            if child in schemas.PARENTS:
                self.delete(child, doomed.select("id"))
            self.replace(child, rows.join(gone, rows[column] == gone["_gone"], "left_anti"))
        own = self.scan(table)
        self.replace(table, own.join(gone, own[key] == gone["_gone"], "left_anti"))

    def latest(self, table: str, by: list[str], order: str = "created_at") -> DataFrame:
        return state.latest(self.scan(table), by, [order])

    def recent(self, table: str, where: Column, limit: int, order: str = "created_at", descending: bool = True) -> DataFrame:
        return self.scan(table, where).orderBy(F.desc(order) if descending else F.asc(order), "id").limit(limit)

    def view(self, table: str) -> DataFrame:
        df = self.scan(table)
        df.createOrReplaceTempView(table)
        return df


class Tasks:
    """Tasks as an append-only log of states; a task is its latest row."""

    def __init__(self, store: Store):
        self.store = store

    def create(self, task_id: str, workspace: str, name: str, description: str = "") -> None:
        self._log(task_id, workspace_id=workspace, name=name, description=description, status="pending", progress=0.0)

    def _log(self, task_id: str, **changes) -> None:
        status = changes.get("status")
        if status is not None and status not in schemas.TASK_STATUSES:
            raise ValueError(f"no such status: {status}")
        now = self.get(task_id).first()
        row = (now.asDict(recursive=True) if now else {}) | changes | {"id": task_id}
        row.pop("updated_at", None)
        kind = [f for f in schemas.schema("tasks").fields if f.name in row]
        df = self.store.spark.createDataFrame([tuple(row[f.name] for f in kind)], schemas.StructType(kind))
        self.store.append("tasks", df)

    def get(self, task_id: str) -> DataFrame:
        return self.all().where(F.col("id") == task_id)

    def all(self) -> DataFrame:
        return self.store.latest("tasks", ["id"], "updated_at")

    def listing(self, workspace: str, limit: int = 50) -> DataFrame:
        return self.all().where(F.col("workspace_id") == workspace).orderBy(F.desc("created_at"), "id").limit(limit)

    def progress(self, task_id: str, value: float) -> None:
        self._log(task_id, status="running", progress=min(max(value, 0.0), 1.0))

    def complete(self, task_id: str, result: str) -> None:
        self._log(task_id, status="completed", progress=1.0, result=result)

    def fail(self, task_id: str, error: str) -> None:
        self._log(task_id, status="failed", error=error)

    def cancel(self, task_id: str) -> None:
        self._log(task_id, status="cancelled")

    def run(self, task_id: str, work, done=None) -> None:
        """Runs work(), a callable that returns the result, and logs its end; done(task_id) is called afterwards."""
        self.progress(task_id, 0.0)
        try:
            self.complete(task_id, str(work()))
        except Exception as error:  # noqa: BLE001 - any failure of the work is the task's result
            self.fail(task_id, str(error))
        if done:
            done(task_id)
