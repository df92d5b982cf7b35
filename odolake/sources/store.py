"""Recordings on a shared file system: parquet partitioned by recording, with an append-only catalog.

readings/<schema fingerprint>/dataset_id=<id>/version=<n>/*.parquet holds the rows; recordings with the same
columns share a folder, so any number of them is one scan with partition pruning. catalog/*.parquet gets one
small row per change; the newest row of a recording is its state.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Sequence as Seq
from itertools import chain
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RequestError
from ..fixed_values import SUPPORTED_EXTENSIONS
from ..functions.scalars import clean_tags
from ..limits import require
from ..operators.catalog import distinct_tags, edit_tags, filter_by_tags, newest_first, set_tags
from ..operators.frames import lookup
from ..operators.schema import coordinate_columns, has_other_signals, kind_of
from .bulk import Batch, check_positions, read_csv_files, read_parquet_files
from .readers import extension, read_recording, stitch, union_by_name

TEXTS = T.ArrayType(T.StringType())
CATALOG_SCHEMA = T.StructType([T.StructField(name, dtype) for name, dtype in (
    ("dataset_id", T.StringType()), ("name", T.StringType()), ("original_filename", T.StringType()),
    ("row_count", T.LongType()), ("column_count", T.IntegerType()), ("file_size", T.LongType()), ("tags", TEXTS),
    ("created_at", T.TimestampType()), ("coord_kind", T.StringType()), ("coord_cols", TEXTS),
    ("extra_signals", T.BooleanType()), ("fingerprint", T.StringType()), ("schema_json", T.StringType()),
    ("version", T.LongType()), ("changed", T.LongType()), ("deleted", T.BooleanType()))])
LABELSET_SCHEMA = "id string, name string, dataset_id string, columns array<string>, created_at timestamp"
ALIAS_SCHEMA = "id string, canonical_name string, column_name string"


class RecordingStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- catalog ---------------------------------------------------------

    def _path(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _exists(self, path: str) -> bool:
        fs, target = self._path(path)
        return fs.exists(target)

    def _remove(self, path: str) -> None:
        fs, target = self._path(path)
        fs.delete(target, True)

    def _history(self) -> DataFrame:
        path = f"{self.root}/catalog"
        if not self._exists(path):
            return self.spark.createDataFrame([], CATALOG_SCHEMA)
        return self.spark.read.schema(CATALOG_SCHEMA).parquet(path)

    def catalog(self) -> DataFrame:
        """Current recordings: the newest change of each, without removed ones."""
        newest = self._history().groupBy("dataset_id").agg(F.max_by(F.struct(*CATALOG_SCHEMA.names), "changed").alias("r"))
        return newest.select("r.*").filter(~F.col("deleted"))

    def list_datasets(self) -> DataFrame:
        return newest_first(self.catalog())

    def get(self, dataset_id: str):
        row = self.catalog().filter(F.col("dataset_id") == dataset_id).first()
        if row is None:
            raise RequestError(f"no such dataset: {dataset_id}")
        return row

    def _append(self, rows: DataFrame) -> None:
        stamped = rows.withColumn("changed", F.lit(time.time_ns()))
        typed = stamped.select(*[F.col(f.name).cast(f.dataType) for f in CATALOG_SCHEMA.fields])
        typed.coalesce(1).write.mode("append").parquet(f"{self.root}/catalog")

    # -- ingest ----------------------------------------------------------

    def ingest(self, path: str, name: str | None = None, tags: Seq[str] = (), *, original_filename: str | None = None,
               sep: str | None = None, encoding: str = "UTF-8") -> str:
        """Store one CSV or Parquet file as a recording; gives its id. The CSV dialect is found unless `sep` names it."""
        kind = extension(path)
        file_name = original_filename or PurePosixPath(path).name
        fs, target = self._path(path)
        require(fs.exists(target), f"cannot read {path}")
        if kind == ".csv":
            names = {self._plain(path): (name or PurePosixPath(file_name).stem, file_name)}
            return self._ingest_files([path], tags, names, sep, encoding)[self._plain(path)]
        size = fs.getContentSummary(target).getLength()
        return self.add(read_recording(self.spark, path), name or PurePosixPath(file_name).stem, tags,
                        original_filename=file_name, file_size=size)

    def ingest_many(self, paths: str | Seq[str], tags: Seq[str] = (), *, sep: str | None = None, encoding: str = "UTF-8") -> dict[str, str]:
        """Store files, or all CSV and Parquet files below a folder, as a recording each: {path: id}.

        All files are read in a few jobs, each recording's rows are written to its own folder without a shuffle, and one catalog
        file makes all of them known at once. After an error none of them is stored.
        """
        listed = self._files_below(paths) if isinstance(paths, str) else list(paths)
        require(bool(listed), "no CSV or Parquet files")
        return self._ingest_files(listed, tags, {}, sep, encoding)

    def _plain(self, path: str) -> str:
        """The path with its scheme, as Spark reports it for a row."""
        fs, target = self._path(path)
        return fs.makeQualified(target).toString()

    def _files_below(self, folder: str) -> list[str]:
        fs, target = self._path(folder)
        require(fs.exists(target), f"cannot read {folder}")
        found, files = [], fs.listFiles(target, True)
        while files.hasNext():
            name = files.next().getPath().toString()
            if PurePosixPath(name).suffix.lower() in SUPPORTED_EXTENSIONS:
                found.append(name)
        return sorted(found)

    def _ingest_files(self, paths: Seq[str], tags: Seq[str], names: dict, sep: str | None, encoding: str) -> dict[str, str]:
        kinds: dict[bool, dict[str, int]] = {True: {}, False: {}}
        for path in paths:
            fs, target = self._path(path)
            require(fs.exists(target), f"cannot read {path}")
            status = fs.getFileStatus(target)
            kinds[extension(path) == ".csv"][fs.makeQualified(target).toString()] = status.getLen()
        sizes = kinds[True] | kinds[False]
        version, ids, changes = time.time_ns(), {p: uuid.uuid4().hex[:12] for p in sizes}, []
        folders: set[str] = set()
        try:
            batches = chain(read_csv_files(self.spark, list(kinds[True]), encoding=encoding, separator=sep) if kinds[True] else (),
                            read_parquet_files(self.spark, list(kinds[False])) if kinds[False] else ())
            for batch in batches:
                changes += self._write_batch(batch, ids, sizes, names, [str(t) for t in tags], version, folders)
            missing = set(ids) - {c[0] for c in changes}
            require(not missing, f"{len(missing)} files have no rows and no header, such as {min(missing, default='')}")
        except BaseException:
            for folder in folders:
                self._remove(folder)
            raise
        change = self.spark.createDataFrame([c[1] for c in changes], CATALOG_SCHEMA)
        self._append(change.withColumn("tags", clean_tags(F.col("tags"))).withColumn("created_at", F.current_timestamp()))
        return ids

    def _write_batch(self, batch: Batch, ids: dict, sizes: dict, names: dict, tags: list[str], version: int,
                     folders: set[str]) -> list[tuple]:
        """Rows of a batch under their recordings' folders; gives (path, catalog row) of each."""
        body = batch.rows.drop("__file")
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in body.schema.fields])
        fingerprint = hashlib.sha256(schema.json().encode()).hexdigest()[:16]
        paths = {key: self._key_path(key, ids) for key in batch.counts}
        owners = self.spark.createDataFrame([(key, ids[path]) for key, path in paths.items()], "__file string, dataset_id string")
        rows = lookup(batch.rows, owners, ["__file"]).drop("__file").withColumn("version", F.lit(version))
        folder = f"{self.root}/readings/{fingerprint}"
        folders.update(f"{folder}/dataset_id={ids[p]}" for p in paths.values())
        rows.write.mode("append").partitionBy("dataset_id", "version").parquet(folder)
        written = [f"{folder}/dataset_id={ids[p]}/version={version}" for k, p in paths.items() if batch.counts[k]]
        if written:
            positions = self.spark.read.schema("row_pos bigint, dataset_id string").option("basePath", folder).parquet(*written)
            check_positions(positions, {ids[p]: batch.counts[k] for k, p in paths.items()}, "dataset_id")
        signals = [(f.name, kind_of(f.dataType)) for f in schema.fields if f.name != "row_pos"]
        kind, coords = coordinate_columns(signals)
        out = []
        for key, path in paths.items():
            file_name = PurePosixPath(path).name
            name, original = names.get(path, (PurePosixPath(file_name).stem, file_name))
            out.append((path, (ids[path], name, original, batch.counts[key], len(signals), sizes[path], tags, None, kind, coords,
                               has_other_signals(signals), fingerprint, schema.json(), version, 0, False)))
        return out

    def _key_path(self, key: str, ids: dict) -> str:
        """The listed path of a file as a row names it, with one slash or three after the scheme."""
        for form in (key, key.replace(":///", ":/", 1), key.replace(":/", ":///", 1)):
            if form in ids:
                return form
        raise RequestError(f"a row comes from an unlisted file: {key}")

    def add(self, df: DataFrame, name: str, tags: Seq[str] = (), *, original_filename: str | None = None,
            file_size: int = 0, dataset_id: str | None = None) -> str:
        """Store a frame with row_pos as a recording."""
        require("row_pos" in df.columns, "rows need a row_pos column")
        dataset_id = dataset_id or uuid.uuid4().hex[:12]
        self._write(df, dataset_id, {"name": name, "original_filename": original_filename or name,
                                     "file_size": file_size, "tags": [str(t) for t in tags], "created_at": None})
        return dataset_id

    def _write(self, df: DataFrame, dataset_id: str, fields: dict) -> None:
        body = df.drop("dataset_id")
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in body.schema.fields])
        fingerprint = hashlib.sha256(schema.json().encode()).hexdigest()[:16]
        version = time.time_ns()
        path = f"{self.root}/readings/{fingerprint}/dataset_id={dataset_id}/version={version}"
        body.write.parquet(path)
        rows = self.spark.read.schema(schema).parquet(path).count()  # from the footers
        signals = [(f.name, kind_of(f.dataType)) for f in schema.fields if f.name != "row_pos"]
        kind, coords = coordinate_columns(signals)
        made = fields["created_at"]
        row = (dataset_id, fields["name"], fields["original_filename"], rows, len(signals), fields["file_size"],
               fields["tags"], made, kind, coords, has_other_signals(signals), fingerprint, schema.json(),
               version, 0, False)
        change = self.spark.createDataFrame([row], CATALOG_SCHEMA).withColumn("tags", clean_tags(F.col("tags")))
        if made is None:
            change = change.withColumn("created_at", F.current_timestamp())
        self._append(change)

    def stitch(self, dataset_ids: Seq[str], name: str | None = None, tags: Seq[str] | None = None) -> str:
        """Concatenate recordings in order into a new one; by default with the union of their tags."""
        require(len(dataset_ids) >= 2, "stitching needs at least two recordings")
        parts = [self.get(i) for i in dataset_ids]
        if tags is None:
            tags = list(dict.fromkeys(t for p in parts for t in p["tags"]))
        name = name or ("joined_" + "+".join(p["name"] for p in parts))[:120]
        rows = stitch([self.load([i]).drop("dataset_id") for i in dataset_ids])
        return self.add(rows, name, tags, original_filename=f"{name}.concat")

    def write_back(self, df: DataFrame, dataset_id: str) -> None:
        """Replace a recording's rows, for instance after adding a label column. The old version goes last."""
        old = self.get(dataset_id)
        self._write(df, dataset_id, {k: old[k] for k in ("name", "original_filename", "file_size", "tags", "created_at")})
        self._remove(f"{self.root}/readings/{old['fingerprint']}/dataset_id={dataset_id}/version={old['version']}")

    # -- reading ---------------------------------------------------------

    def load(self, dataset_ids: Seq[str] | DataFrame | None = None, columns: Seq[str] | None = None) -> DataFrame:
        """Rows of the recordings (all of them by default) as one frame with dataset_id and row_pos.

        One scan per distinct schema. The catalog names the folder of each recording's newest rows, so other recordings are
        neither listed nor opened; only the asked columns are read.
        """
        current = self.catalog()
        if isinstance(dataset_ids, (list, tuple)):
            current = current.filter(F.col("dataset_id").isin(list(dataset_ids)))
        elif dataset_ids is not None:
            current = current.join(dataset_ids.select("dataset_id").distinct(), "dataset_id", "left_semi")
        shapes: dict[tuple[str, str], list[str]] = {}
        for r in current.filter("row_count > 0").select("fingerprint", "schema_json", "dataset_id", "version").toLocalIterator():
            folder = f"{self.root}/readings/{r['fingerprint']}/dataset_id={r['dataset_id']}/version={r['version']}"
            shapes.setdefault((r["fingerprint"], r["schema_json"]), []).append(folder)
        for r in current.filter("row_count = 0").select("fingerprint", "schema_json").distinct().toLocalIterator():
            shapes.setdefault((r["fingerprint"], r["schema_json"]), [])
        require(bool(shapes), "no datasets found")
        frames = []
        for (fingerprint, schema_json), folders in sorted(shapes.items()):
            schema = T.StructType.fromJson(json.loads(schema_json)).add("dataset_id", T.StringType()).add("version", T.LongType())
            rows = (self.spark.read.schema(schema).option("basePath", f"{self.root}/readings/{fingerprint}").parquet(*sorted(folders))
                    if folders else self.spark.createDataFrame([], schema))
            names = [f.name for f in schema.fields if f.name not in ("dataset_id", "version", "row_pos")]
            wanted = [c for c in names if columns is None or c in columns]
            frames.append(rows.select("dataset_id", "row_pos", *[F.col(f"`{c}`") for c in wanted]))
        return union_by_name(frames)

    def dataset(self, dataset_id: str) -> DataFrame:
        self.get(dataset_id)
        return self.load([dataset_id])

    # -- tags and removal ------------------------------------------------

    def update_tags(self, dataset_id: str, tags: Seq[str]) -> None:
        self.get(dataset_id)
        row = self.catalog().filter(F.col("dataset_id") == dataset_id)
        self._append(set_tags(row, tags))

    def bulk_update_tags(self, dataset_ids: Seq[str], add: Seq[str] = (), remove: Seq[str] = ()) -> int:
        """Remove tags, then append the missing ones, in one pass over the catalog."""
        rows = self.catalog().filter(F.col("dataset_id").isin(list(dataset_ids)))
        self._append(edit_tags(rows, add, remove))
        return len(list(dataset_ids))

    def all_tags(self) -> DataFrame:
        return distinct_tags(self.catalog())

    def with_any_tag(self, tags: Seq[str]) -> DataFrame:
        """Catalog rows with any of the tags; all rows when none are given."""
        return filter_by_tags(self.list_datasets(), tags)

    def delete(self, dataset_ids: Seq[str]) -> int:
        rows = self.catalog().filter(F.col("dataset_id").isin(list(dataset_ids)))
        gone = rows.select("dataset_id", "fingerprint").collect()  # the ids the caller listed
        require(len(gone) == len(set(dataset_ids)), "no such dataset among the ids")
        self._append(rows.withColumn("deleted", F.lit(True)))
        for r in gone:
            self._remove(f"{self.root}/readings/{r['fingerprint']}/dataset_id={r['dataset_id']}")
        return len(gone)

    def delete_all(self, include_label_sets: bool = False) -> int:
        count = self.catalog().count()
        for part in ("catalog", "readings", *(["labelsets"] if include_label_sets else [])):
            self._remove(f"{self.root}/{part}")
        return count

    # -- label sets and signal aliases ------------------------------------

    def _rows(self, part: str, schema: str) -> DataFrame:
        path = f"{self.root}/{part}"
        return self.spark.read.schema(schema).parquet(path) if self._exists(path) else \
            self.spark.createDataFrame([], schema)

    def create_label_set(self, name: str, columns: Seq[str], dataset_id: str | None = None) -> str:
        require(bool(columns), "a label set needs a column")
        new_id = uuid.uuid4().hex[:12]
        frame = self.spark.createDataFrame([(new_id, name, dataset_id, list(columns), None)], LABELSET_SCHEMA)
        frame.withColumn("created_at", F.current_timestamp()).drop("id").coalesce(1).write.parquet(
            f"{self.root}/labelsets/id={new_id}")
        return new_id

    def label_sets(self) -> DataFrame:
        return self._rows("labelsets", LABELSET_SCHEMA).orderBy(F.desc("created_at"))

    def delete_label_set(self, label_set_id: str) -> None:
        self._remove(f"{self.root}/labelsets/id={label_set_id}")

    def create_alias(self, canonical_name: str, column_name: str) -> str:
        """Both names trimmed; an existing pair keeps its id."""
        canonical_name, column_name = canonical_name.strip(), column_name.strip()
        require(bool(canonical_name and column_name), "an alias needs both names")
        known = self.aliases().filter(
            (F.col("canonical_name") == canonical_name) & (F.col("column_name") == column_name)).first()
        if known:
            return known["id"]
        new_id = uuid.uuid4().hex[:12]
        frame = self.spark.createDataFrame([(canonical_name, column_name)], "canonical_name string, column_name string")
        frame.coalesce(1).write.parquet(f"{self.root}/aliases/id={new_id}")
        return new_id

    def aliases(self) -> DataFrame:
        return self._rows("aliases", ALIAS_SCHEMA).orderBy("canonical_name", "column_name")

    def alias_pairs(self) -> list[tuple[str, str]]:
        return [(r["canonical_name"], r["column_name"]) for r in self.aliases().collect()]  # user-made settings

    def delete_alias(self, alias_id: str) -> None:
        self._remove(f"{self.root}/aliases/id={alias_id}")

