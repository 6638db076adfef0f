"""History of processed files, download errors and tiles as append-only tables; the newest row of a key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.operators import tiles

FILES = (
    "id long, path string, name string, file_hash string, config_hash string, processed timestamp_ntz, config string, "
    "status string, n_points long, n_legs long, distance_m double, summary string, program_version string"
)
ERRORS = "tile_id string, at timestamp_ntz, message string"
TILES = "tile_id string, version long, state string, downloaded timestamp_ntz, roads long"
MESSAGE_CHARS = 1000


class Catalog:
    """The three tables below one folder, as Parquet."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _append(self, name: str, schema: str, rows: DataFrame) -> None:
        columns = self.spark.createDataFrame([], schema).schema
        rows.select(*[F.col(f.name).cast(f.dataType) for f in columns]).write.mode("append").parquet(f"{self.folder}/{name}")

    def files(self) -> DataFrame:
        return self._read("files", FILES)

    def register_files(self, rows: DataFrame) -> None:
        self._append("files", FILES, rows)

    def errors(self) -> DataFrame:
        return self._read("errors", ERRORS)

    def log_errors(self, rows: DataFrame) -> None:
        self._append("errors", ERRORS, truncated(rows))

    def tile_rows(self) -> DataFrame:
        return self._read("tiles", TILES)

    def tiles(self) -> DataFrame:
        return tiles.latest(self.tile_rows()).orderBy("tile_id")

    def upsert_tiles(self, rows: DataFrame) -> None:
        """A later version of a tile replaces the earlier one when read."""
        self._append("tiles", TILES, rows)

    def clear_tiles(self) -> int:
        n = self.tiles().count()
        self.spark.createDataFrame([], TILES).write.mode("overwrite").parquet(f"{self.folder}/tiles")
        return n


def truncated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("message", F.substring("message", 1, MESSAGE_CHARS))


def previous_runs(files: DataFrame, history: DataFrame) -> DataFrame:
    """Files (file_hash, config_hash) with prior_id: the newest earlier run of equal content and settings, or null.

    A repeat is reported, not skipped.
    """
    newest = history.groupBy("file_hash", "config_hash").agg(F.max("id").alias("prior_id"))
    return files.join(newest, ["file_hash", "config_hash"], "left").withColumn("repeated", F.col("prior_id").isNotNull())


def base_version(used_tiles: DataFrame, catalog: DataFrame) -> DataFrame:
    """Newest download day among the tiles of each file."""
    return used_tiles.join(tiles.latest(catalog), "tile_id").groupBy("file_id").agg(F.max(F.to_date("downloaded")).alias("base_version"))


def cache_size(spark: SparkSession, folder: str) -> int:
    """Bytes of the files below a folder; 0 if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(at).getLength()) if fs.exists(at) else 0
