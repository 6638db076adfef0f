"""Road networks: edges by tile as Parquet, and GraphML files of a street graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GRAPHML = (
    "key ARRAY<STRUCT<_id: STRING, `_attr.name`: STRING, _for: STRING>>, graph STRUCT<"
    "node: ARRAY<STRUCT<_id: STRING, data: ARRAY<STRUCT<_key: STRING, _VALUE: STRING>>>>, "
    "edge: ARRAY<STRUCT<_id: STRING, _source: STRING, _target: STRING, data: ARRAY<STRUCT<_key: STRING, _VALUE: STRING>>>>>"
)


EDGES = (
    "tile_id string, u long, v long, k int, osmid array<string>, name array<string>, official_name array<string>, ref array<string>, alt_name array<string>, "
    "highway array<string>, length_m string, geometry array<struct<lon: double, lat: double>>"
)


def read_edges(spark: SparkSession, folder: str, tiles: DataFrame | None = None) -> DataFrame:
    """Edges of a folder partitioned by ``tile_id``; with ``tiles`` only those, by partition pruning.

    An edge in several tiles counts once; the last tile in order of id wins.
    """
    edges = spark.read.parquet(folder)
    if tiles is not None:
        edges = edges.join(tiles.select("tile_id").distinct(), "tile_id", "left_semi")
    return distinct_edges(edges)


#: The last two sets of tiles that were asked for, with their edges kept.
_KEPT: dict[tuple, DataFrame] = {}


def kept_edges(spark: SparkSession, folder: str, tiles: DataFrame) -> DataFrame:
    """:func:`read_edges`, kept for the next batch that needs the same tiles of the folder."""
    r = tiles.select("tile_id").distinct().agg(F.count(F.lit(1)), F.sum(F.xxhash64("tile_id").cast("decimal(38)"))).first()
    key = (spark.sparkContext.applicationId, folder, r[0], r[1])
    found = _KEPT.pop(key, None)
    _KEPT[key] = read_edges(spark, folder, tiles).persist() if found is None else found
    while len(_KEPT) > 2:
        _KEPT.pop(next(iter(_KEPT))).unpersist()
    return _KEPT[key]


def forget_edges() -> None:
    """Drop all kept edges, for example after tiles changed."""
    while _KEPT:
        _KEPT.popitem()[1].unpersist()


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One row per (u, v, k): of the last tile.  Only ids are ranked; attributes and geometry move once, with partial aggregation."""
    rest = [c for c in edges.columns if c not in ("u", "v", "k")]
    best = edges.groupBy("u", "v", "k").agg(F.max_by(F.struct(*rest), F.col("tile_id")).alias("row"))
    return best.select("u", "v", "k", "row.*").select(*edges.columns)


def write_edges(edges: DataFrame, folder: str, mode: str = "append") -> None:
    """Edges with a column ``tile_id``, one folder per tile; ``overwrite`` replaces the tiles that occur and leaves the others."""
    edges.repartition("tile_id").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("tile_id").parquet(folder)


def stored_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """tile_id of every tile that has edges below ``folder``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "tile_id string")
    return spark.read.parquet(folder).select("tile_id").distinct()


def ingest(spark: SparkSession, staged: str, wanted: DataFrame, folder: str, version: int) -> DataFrame:
    """Take street graphs of the ``wanted`` tiles from ``staged`` (GraphML files named by tile) into ``folder``.

    Returns tile_id, version, roads, error and downloaded, as :func:`routeloom.operators.tiles.apply_downloads` takes them: a tile
    without a file or with one that cannot be read has an error.
    """
    files = _graphml_files(spark, staged).join(wanted.select("tile_id").distinct(), "tile_id", "left_semi")
    edges = graphml_edges(files).persist()
    write_edges(edges, folder, "overwrite")
    counts = edges.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"))
    seen = files.select("tile_id", F.col("g").isNotNull().alias("read"))
    out = wanted.select("tile_id").distinct().join(seen, "tile_id", "left").join(counts, "tile_id", "left")
    error = F.when(F.col("read").isNull(), "no staged file").when(~F.col("read"), "not a readable street graph")
    rows = out.select("tile_id", F.lit(version).cast("long").alias("version"), F.coalesce("n", F.lit(0)).alias("roads"), error.alias("error"), F.current_timestamp().cast("timestamp_ntz").alias("downloaded"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)  # one row a tile of this batch
    edges.unpersist()
    forget_edges()
    return rows


def _values(listed: Column) -> Column:
    """A scalar or a list in square brackets as an array of texts."""
    inner = F.regexp_replace(listed, r"^\[|\]$", "")
    many = F.transform(F.split(inner, r",\s*"), lambda x: F.regexp_replace(x, r"^['\"]|['\"]$", ""))
    return F.when(listed.isNull(), F.lit(None)).when(listed.startswith("["), many).otherwise(F.array(listed))


def _graphml_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """tile_id (file name) and the parsed tree ``g`` of GraphML files, null where a file cannot be read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.graphml").load(path)
    return graphml_trees(files.select("path", "content"))


def graphml_trees(files: DataFrame) -> DataFrame:
    """Rows (path, content) as tile_id and ``g``."""
    xml = F.make_valid_utf8(F.col("content").cast("string"))
    tree = F.when(xml.contains("<graphml"), F.from_xml(xml, F.lit(_GRAPHML), {"ignoreNamespace": "true"}))
    return files.select(F.regexp_extract("path", r"([^/]+)\.graphml$", 1).alias("tile_id"), F.when(tree["graph"].isNotNull(), tree).alias("g"))


def read_graphml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Edges of GraphML street graphs, see :func:`graphml_edges`."""
    return graphml_edges(_graphml_files(spark, path))


def graphml_edges(g: DataFrame) -> DataFrame:
    """Edges of parsed street graphs: tile_id, u, v, k, attributes, length_m and geometry (lon, lat).

    Edges without a geometry run straight between their nodes.
    """
    names = F.map_from_arrays(F.transform("g.key", lambda k: k["_id"]), F.transform("g.key", lambda k: k["_attr.name"]))
    g = g.select("tile_id", "g", names.alias("names"))

    def value(data: str, name: str) -> Column:
        hit = F.filter(data, lambda x: F.try_element_at("names", x["_key"]) == name)
        return F.try_element_at(F.transform(hit, lambda x: x["_VALUE"]), F.lit(1))

    node = g.select("tile_id", "names", F.explode("g.graph.node").alias("n")).select(
        "tile_id", F.col("n._id").cast("long").alias("node"), value("n.data", "x").cast("double").alias("lon"), value("n.data", "y").cast("double").alias("lat")
    )
    edge = g.select("tile_id", "names", F.explode("g.graph.edge").alias("e")).select(
        "tile_id", F.col("e._source").cast("long").alias("u"), F.col("e._target").cast("long").alias("v"),
        F.coalesce(F.col("e._id").try_cast("int"), F.lit(0)).alias("k"),
        *[_values(value("e.data", c)).alias(c) for c in ("osmid", "name", "official_name", "ref", "alt_name", "highway")],
        value("e.data", "length").alias("length_m"), value("e.data", "geometry").alias("wkt"),
    )
    for end in ("u", "v"):
        own = node.select("tile_id", F.col("node").alias(end), F.struct("lon", "lat").alias(f"at_{end}"))
        edge = edge.join(own, ["tile_id", end])
    pairs = F.split(F.regexp_extract("wkt", r"\(([^)]*)\)", 1), r",\s*")
    line = F.transform(pairs, lambda p: F.struct(F.split(p, r"\s+")[0].cast("double").alias("lon"), F.split(p, r"\s+")[1].cast("double").alias("lat")))
    return edge.withColumn("geometry", F.when(F.col("wkt").isNotNull(), line).otherwise(F.array("at_u", "at_v"))).drop("wkt", "at_u", "at_v")
