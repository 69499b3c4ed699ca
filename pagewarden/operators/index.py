"""The page index: a Parquet table that grows by versions.

    <path>/records/version=<n>/batch=<id>/unique_id=<tenant>/part-*.parquet
    <path>/files/version=<n>/batch=<id>/part-*.parquet
    <path>/deletes/version=<n>/batch=<id>/part-*.parquet

A folder per tenant suits up to some thousands of tenants. With more, ask for
`buckets`: tenants then share that many folders by a hash of their name, and
files are sorted by tenant, so that a reader skips the parts of others.

Each write makes one version and counts once its `_SUCCESS` marker stands, so a
write that dies halfway is never read. A delete writes the names of the files it
removes; reading leaves out records of those files from earlier versions. No
record is rewritten, which matters where one tenant holds much of the data;
`compact` writes the remaining records to a new place when that pays.
Beside each version stand its files with their record counts, so lists, counts and
deletes read no records. One writer at a time.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewarden.constants import TENANT_PAGE_SIZE
from pagewarden.functions.text import shares_token
from pagewarden.schema import PAGE_KEY, PLACE, SPARSE_VECTOR, index_record
from pagewarden.sources.requests import manifest_requests

FILE_KEY = ["unique_id", "file_path"]
_DELETED = "unique_id string, file_path string, version bigint, batch string"
_FILES = "unique_id string, file_path string, n_records bigint, version bigint, batch string"
_VERSION = re.compile(r"/version=(\d+)/batch=([^/]+)")


class PageIndex:
    def __init__(
        self,
        spark: SparkSession,
        path: str,
        vector: T.DataType = SPARSE_VECTOR,
        buckets: int | None = None,
    ):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = index_record(vector)
        self.buckets = buckets
        self.folder = "bucket" if buckets else "unique_id"

    # -- versions ---------------------------------------------------------

    def _glob(self, pattern: str) -> list[str]:
        """Names only, one request to the file system, nothing read."""
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        system = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [status.getPath().toString() for status in system.globStatus(target) or []]

    def _committed(self, kind: str) -> list[str]:
        done = self._glob(f"{kind}/version=*/batch=*/_SUCCESS")
        return sorted(path.rsplit("/", 1)[0] for path in done)

    def _version_for(self, batch_id: str) -> int:
        """Next version, or the one a repeated batch wrote before."""
        highest = 0
        for path in self._glob("*/version=*/batch=*"):
            number, batch = _VERSION.search(path).groups()
            if batch == batch_id and "/records/" in path:
                return int(number)
            highest = max(highest, int(number))
        return highest + 1

    def _place(self, kind: str, version: int, batch_id: str) -> str:
        return f"{self.path}/{kind}/version={version:09d}/batch={batch_id}"

    def exists(self) -> bool:
        return bool(self._glob("records"))

    def create(self) -> bool:
        """Make the empty index; False if it was there. May be called again."""
        if self.exists():
            return False
        empty = self.spark.createDataFrame([], self.schema)
        self._write(empty, self._place("records", 0, "create"), gather=False)
        return True

    # -- writing ----------------------------------------------------------

    def _bucket(self, unique_id: Column) -> Column:
        return F.pmod(F.xxhash64(unique_id), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, place: str, gather: bool) -> None:
        if self.buckets:
            rows = rows.withColumn("bucket", self._bucket(F.col("unique_id")))
        if gather:
            rows = rows.hint("rebalance", self.folder)
        if self.buckets:
            rows = rows.sortWithinPartitions("bucket", *PAGE_KEY)
        rows.write.mode("overwrite").partitionBy(self.folder).parquet(place)

    def append(
        self,
        records: DataFrame,
        batch_id: str | None = None,
        replace: bool = False,
        gather: bool = True,
    ) -> int:
        """Add records as one version and return its number.

        Repeating a `batch_id` overwrites what it wrote before. Records are
        appended, also for a file that is indexed already, unless `replace`
        asks to drop the file's earlier records.

        With `gather`, rows are brought together by tenant before the write, so
        a tenant becomes few files; the adaptive planner splits a large tenant
        over tasks. It shuffles every record. Without it each task writes a file
        per tenant it meets, which is the better way for few tenants and large
        tasks.
        """
        batch_id = batch_id or uuid.uuid4().hex
        version = self._version_for(batch_id)
        place = self._place("records", version, batch_id)
        names = self.schema.fieldNames()
        # Columns a caller may leave out, such as the model or the vector.
        missing = {
            f.name: F.lit(None).cast(f.dataType)
            for f in self.schema.fields
            if f.name not in records.columns
        }
        self._write(records.withColumns(missing).select(*names), place, gather)
        counted = self._place("files", version, batch_id)
        _counts(self._scan([place])).write.mode("overwrite").parquet(counted)
        if replace:
            # After the data: dying in between leaves a file doubled, never lost.
            earlier = self._files(before=version)
            if earlier is not None:
                written = self.spark.read.schema(_FILES).parquet(counted).select(*FILE_KEY)
                known = written.join(earlier.select(*FILE_KEY), FILE_KEY, "left_semi")
                known.write.mode("overwrite").parquet(self._place("deletes", version, batch_id))
        return version

    def _files(self, before: int | None = None) -> DataFrame | None:
        """(unique_id, file_path, n_records, version) of the versions that stand, deleted or not."""
        places = {}
        for place in self._committed("records"):
            number, batch = _VERSION.search(place).groups()
            if before is None or int(number) < before:
                places[self._place("files", int(number), batch).removeprefix(self.path)] = place
        known = {_below(place): place for place in self._committed("files")}
        counted = [known[name] for name in places if name in known]
        # A write that died between data and counts is counted again.
        rest = [place for name, place in places.items() if name not in known]
        parts = []
        if counted:
            reader = self.spark.read.schema(_FILES).option("basePath", f"{self.path}/files")
            parts.append(reader.parquet(*counted).drop("batch"))
        if rest:
            parts.append(_counts(self._scan(rest), "version"))
        return reduce(DataFrame.unionByName, parts) if parts else None

    # -- reading ----------------------------------------------------------

    def _scan(self, places: list[str]) -> DataFrame:
        folders = [T.StructField("version", T.LongType()), T.StructField("batch", T.StringType())]
        if self.buckets:
            folders.append(T.StructField("bucket", T.IntegerType()))
        schema = T.StructType([*self.schema.fields, *folders])
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/records")
        rows = reader.parquet(*places)
        return rows.select(
            "*",
            F.col("_metadata.file_path").alias(PLACE[0]),
            F.col("_metadata.row_index").alias(PLACE[1]),
        )

    def _versioned(self) -> DataFrame:
        places = self._committed("records")
        if not places:
            raise FileNotFoundError(f"no index at {self.path}")
        rows = self._scan(places)
        deletes = self._committed("deletes")
        if not deletes:
            return rows
        # Records newer than the last delete are not compared with any.
        last = max(int(_VERSION.search(place)[1]) for place in deletes)
        newer = [place for place in places if int(_VERSION.search(place)[1]) >= last]
        older = [place for place in places if place not in set(newer)]
        if not older:
            return rows
        left = self._left(self._scan(older), deletes)
        return left.unionByName(self._scan(newer)) if newer else left

    def _left(self, rows: DataFrame, deletes: list[str]) -> DataFrame:
        """Rows of a version without those that a later delete names."""
        reader = self.spark.read.schema(_DELETED).option("basePath", f"{self.path}/deletes")
        removed = reader.parquet(*deletes).groupBy(*FILE_KEY).agg(
            F.max("version").alias("_until")
        )
        gone = (
            (rows["unique_id"] == removed["unique_id"])
            & (rows["file_path"] == removed["file_path"])
            & (rows["version"] < removed["_until"])
        )
        return rows.join(removed, gone, "left_anti")

    def read(self, unique_ids: list[str] | None = None) -> DataFrame:
        """All records that are not deleted, or those of some tenants.

        Each comes with its place, which tells equal records apart; a search over records
        without it gives every copy of a hit its rank.
        """
        rows = self._versioned()
        if unique_ids is not None:
            rows = rows.where(F.col("unique_id").isin(list(unique_ids)))
            if self.buckets:
                # Worked out while planning, so only these folders are read.
                rows = rows.where(
                    F.col("bucket").isin([self._bucket(F.lit(name)) for name in unique_ids])
                )
        return rows.select(*self.schema.fieldNames(), *PLACE)

    # -- listing ----------------------------------------------------------

    def files(self) -> DataFrame:
        """(unique_id, file_path, num_pages) of all files, from the counts beside the versions."""
        counted = self._files()
        if counted is None:
            raise FileNotFoundError(f"no index at {self.path}")
        deletes = self._committed("deletes")
        left = self._left(counted, deletes) if deletes else counted
        return left.groupBy(*FILE_KEY).agg(F.sum("n_records").alias("num_pages"))

    def tenants(self, n: int = TENANT_PAGE_SIZE, after: str | None = None) -> DataFrame:
        """Tenants with their record counts, in order; `after` gives the next page."""
        files = self.files()
        rows = files if after is None else files.where(F.col("unique_id") > after)
        counts = rows.groupBy("unique_id").agg(F.sum("num_pages").alias("doc_count"))
        return counts.orderBy("unique_id").limit(n)

    def list_docs(self, unique_ids: list[str]) -> DataFrame:
        return self.files().where(F.col("unique_id").isin(list(unique_ids)))

    # -- deleting ---------------------------------------------------------

    def _delete(self, matching: DataFrame) -> int:
        batch_id = uuid.uuid4().hex
        place = self._place("deletes", self._version_for(batch_id), batch_id)
        matching.write.parquet(place)
        written = self.spark.read.parquet(place)
        return written.agg(F.coalesce(F.sum("num_pages"), F.lit(0))).first()[0]

    def delete_where(self, condition: Column) -> int:
        """Delete whole files by a condition on `unique_id` and `file_path`."""
        return self._delete(self.files().where(condition))

    def delete_path(self, file_path: str, unique_id: str | None = None) -> int:
        """Delete the file of exactly this path; of every tenant unless one is given."""
        condition = F.col("file_path") == file_path
        if unique_id is not None:
            condition = condition & (F.col("unique_id") == unique_id)
        return self.delete_where(condition)

    def delete_match(self, wanted: str) -> int:
        """Delete every file whose path shares a token with the text, be it only `pdf`."""
        return self.delete_where(shares_token(F.col("file_path"), wanted))

    def delete_files(self, requests: DataFrame) -> int:
        """Delete the files of a request table (unique_id, file_path) in one pass."""
        wanted = requests.select(*FILE_KEY).distinct()
        return self._delete(self.files().join(wanted, FILE_KEY, "left_semi"))

    def delete_manifest(self, path: str) -> int:
        """Delete the files that JSON manifests name, whatever their tenant."""
        named = manifest_requests(self.spark, path).select("file_path").distinct()
        return self._delete(self.files().join(named, "file_path", "left_semi"))

    def compact(self, path: str) -> "PageIndex":
        """Write the remaining records to a new index and return that."""
        vector = self.schema["text_embedding"].dataType
        target = PageIndex(self.spark, path, vector, self.buckets)
        target.append(self.read(), batch_id="compact")
        return target


def _below(place: str) -> str:
    """The part of a place that tells version and batch."""
    return place[place.rindex("/files/version=") :]


def _counts(records: DataFrame, *keys: str) -> DataFrame:
    return records.groupBy(*FILE_KEY, *keys).agg(F.count(F.lit(1)).alias("n_records"))


def tenant_counts(records: DataFrame, n: int = TENANT_PAGE_SIZE, after: str | None = None) -> DataFrame:
    rows = records if after is None else records.where(F.col("unique_id") > after)
    counts = rows.groupBy("unique_id").agg(F.count(F.lit(1)).alias("doc_count"))
    return counts.orderBy("unique_id").limit(n)


def files_of(records: DataFrame) -> DataFrame:
    """Files with their page counts, one row each: a tenant's list may be of any length."""
    return records.groupBy(*FILE_KEY).agg(F.count(F.lit(1)).alias("num_pages"))
