"""Sources with gates, and sinks whose order is stated."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .envelopes import RANGE_BYTES, envelope_parts
from .storage import opened

ELEMENTS = """array<struct<type: string, id: long, tags: map<string, string>, lat: double, lon: double,
  members: array<struct<type: string, ref: long, role: string, geometry: array<struct<lat: double, lon: double>>>>,
  geometry: array<struct<lat: double, lon: double>>>>"""


def read_elements(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per element of envelope files {elements: [...], remark: ...}; a large file is read by several tasks."""
    parts = envelope_parts(spark, path, "elements", ELEMENTS, range_bytes)
    return parts.select(F.get_json_object("envelope", "$.remark").alias("remark"), F.explode("entries").alias("e")).select("remark", "e.*")


def member_rows(elements: DataFrame) -> DataFrame:
    return elements.select("id", F.posexplode_outer("members").alias("pos", "m")).select("id", "pos", F.col("m.type").alias("type"), F.col("m.ref").alias("ref"), F.col("m.role").alias("role"))


def vertex_rows(elements: DataFrame) -> DataFrame:
    return elements.select("id", F.posexplode("geometry").alias("seq", "g")).select("id", "seq", F.col("g.lon").alias("lon"), F.col("g.lat").alias("lat"))


def read_keyed(spark: SparkSession, path: str, field: str, record: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(key, record fields) of files {field: {key: {...}}}; ``record`` is the record's schema."""
    parts = envelope_parts(spark, path, field, f"map<string, struct<{record}>>", range_bytes)
    return parts.select(F.explode("entries").alias("key", "r")).select("key", "r.*")


def read_published(spark: SparkSession, path: str, rows: str, totals: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows and published totals that stand in one file {rows: [...], published: [...]}."""
    part = lambda field, record: envelope_parts(spark, path, field, f"array<struct<{record}>>", range_bytes).select(F.inline("entries"))
    return part("rows", rows), part("published", totals)


def typed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns with their types; others are not read."""
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()])


DIGESTS = "file string, bytes long, sha256 string"
READ_BYTES = 1 << 22


def digests(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, bytes, sha256) of source files, for provenance. A file is read in pieces, so its size is no matter."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "length")  # the content is not read

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uri in batch.column(0).to_pylist():
                system, path = opened(uri)
                digest = hashlib.sha256()
                with system.open_input_stream(path) as f:
                    while piece := f.read(READ_BYTES):
                        digest.update(piece)
                out.append(digest.hexdigest())
            names = [u.rsplit("/", 1)[-1] for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column(1), pa.array(out, pa.string())], names=["file", "bytes", "sha256"])

    return files.mapInArrow(hashed, DIGESTS)


@dataclass(frozen=True)
class Gate:
    type: str
    at_least: int
    most_without_geometry: float = 0.10


def gate(df: DataFrame, type_of: Column, has_geometry: Column, rule: Gate, remark: Column | None = None) -> DataFrame:
    """One row: rows of the wanted type, others, the share of the wanted without geometry, remarks, and whether the source is accepted.

    Only rows of the wanted type count, as a source may bring others along; a source that carries an error remark
    (``remark`` filled on any row) is refused whatever else it holds, as its rows may be cut short.
    """
    wanted = F.coalesce(type_of == rule.type, F.lit(False))
    bare = F.count_if(wanted & ~F.coalesce(has_geometry, F.lit(False)))
    remarks = F.count_if(F.coalesce(F.length(remark) > 0, F.lit(False))) if remark is not None else F.lit(0).cast("long")
    counts = df.agg(F.count_if(wanted).alias("rows"), F.count_if(~wanted).alias("others"), bare.alias("bare"), remarks.alias("remarks"))
    accepted = (F.col("rows") >= rule.at_least) & (F.col("bare") <= rule.most_without_geometry * F.col("rows")) & (F.col("remarks") == 0)
    return counts.select("rows", "others", F.round(F.try_divide("bare", "rows"), 6).alias("without"), "remarks", accepted.alias("accepted"))


def summary(df: DataFrame, name: Column, level: Column) -> DataFrame:
    """Rows and named rows per level; rows without one are 'untagged'."""
    filled = F.when(F.trim(level) != "", level)
    return df.groupBy(F.coalesce(filled, F.lit("untagged")).alias("level")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(F.trim(name) != "", F.lit(False))).alias("named"))


def write_rows(df: DataFrame, path: str, *order: str) -> None:
    """One row per line in a stated order, so that differences are per row."""
    df.orderBy(*order).write.mode("error").json(path)


def write_artifact(df: DataFrame, path: str, order: str, provenance: DataFrame, sources: DataFrame | None = None) -> str:
    """Writes rows sorted by key with their provenance, and publishes both at once; returns the run's name.

    ``provenance`` is one row; the digests of ``sources`` go into it, sorted by file, as the nested column
    ``sources_read``. A run is written to a folder of its own; readers see it only when its name has been added to
    ``published``, which is the last step. So a run that fails leaves the artifact as it was.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    stamp = provenance
    if sources is not None:
        read = sources.agg(F.array_sort(F.collect_list(F.struct("file", "bytes", "sha256"))).alias("sources_read"))
        stamp = provenance.withColumn("__one", F.lit(1)).join(read.withColumn("__one", F.lit(1)), "__one").drop("__one")
    df.orderBy(order).write.mode("error").parquet(f"{path}/runs/{run}/rows")
    stamp.write.mode("error").parquet(f"{path}/runs/{run}/provenance")
    number = (_published(spark, path) or (0, ""))[0] + 1
    spark.createDataFrame([(number, run, order)], PUBLISHED).coalesce(1).write.mode("append").parquet(f"{path}/published")
    return run


PUBLISHED = "number long, run string, order string"


def _published(spark: SparkSession, path: str) -> tuple[int, str, str] | None:
    try:
        known = spark.read.schema(PUBLISHED).parquet(f"{path}/published")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = known.orderBy(F.desc("number"), "run").first()
    return None if last is None else tuple(last)


def read_artifact(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows and the one row of provenance of the run that was published last. Raises ValueError where there is none."""
    last = _published(spark, path)
    if last is None:
        raise ValueError(f"nothing is published at {path}")
    return tuple(spark.read.parquet(f"{path}/runs/{last[1]}/{part}") for part in ("rows", "provenance"))


def neighbour_lists(edges: DataFrame, roster: DataFrame) -> DataFrame:
    """(atom, neighbours sorted, n) of the roster, isolated atoms with none."""
    n = edges.groupBy(F.col("src").alias("atom")).agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))
    kind = n.schema["neighbours"].dataType
    return roster.join(n, "atom", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast(kind))).withColumn("n", F.size("neighbours"))


def other_run(mine: DataFrame, input_: DataFrame, run: str = "run_id") -> DataFrame:
    """Runs that an input was built by and that are not mine; to be empty before the input is used."""
    return input_.select(run).distinct().join(mine.select(run).distinct(), run, "left_anti")
