"""Sources: tables, JSON lines, binary files, CSV and vectors, with the checks that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "file_id string, domain string, n_bytes bigint, sha256 string, split string, source_path string, licenses string, parse_ok boolean"
STRUCTURE = "file_id string, node_type string, parent_type string, depth bigint, start_byte bigint, end_byte bigint"
BOUNDARIES = "file_id string, byte_offset bigint, trigger string, entropy float, patch_index int, patch_length int"
STATUS = "file_id string, status string, attempt int, t string, n_bytes bigint, n_patches bigint, error string"
SAMPLE_MANIFEST = "schema_version string, sample_id string, split string, domain string, language string, source_name string, text_sha256 string, byte_length bigint, text_path string, synthetic boolean"
NODES = "sample_id string, node_id string, node_type string, start_byte bigint, end_byte bigint, depth bigint, is_primary_alignment_target boolean"


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Whole or pruned to columns; a missing column is an error that names it."""
    df = spark.read.parquet(path)
    missing = sorted(set(columns or ()) - set(df.columns))
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return df.select(*columns) if columns else df


def checked(df: DataFrame, schema: str, key: str = "file_id", known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """df cast to a schema, and its rows whose key is null or, with ``known``, not in that table."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    cast = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted))
    foreign = cast.where(F.col(key).isNull())
    if known is not None:
        foreign = cast.join(known.select(key), key, "left_anti").unionByName(foreign)
    return cast, foreign


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped. ``strict``: a torn line or a number that isn't finite fails,
    else the line is dropped, as in a log whose writer was stopped."""
    reader = spark.read.schema(schema).option("allowNonNumericNumbers", "false")
    return reader.option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def binary(spark: SparkSession, path: str, pattern: str = "*.bin") -> DataFrame:
    """file_id (the name without its ending), content, n_bytes, sha256 of a folder's files."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return df.select(name.alias("file_id"), "content", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def verified(files: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that agree with the manifest in length and hash, and a quarantine of (file_id, problem)."""
    want = manifest.select("file_id", F.col("n_bytes").alias("want_n"), F.col("sha256").alias("want_sha"))
    joined = want.join(files, "file_id", "left")
    problem = F.when(F.col("content").isNull(), "missing").when(F.col("n_bytes") != F.col("want_n"), "length").when(F.col("sha256") != F.col("want_sha"), "sha256")
    joined = joined.withColumn("problem", problem)
    return joined.where("problem IS NULL").drop("problem", "want_n", "want_sha"), joined.where("problem IS NOT NULL").select("file_id", "problem")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(path)


def vectors(spark: SparkSession, path: str, column: str, n: str | None = None) -> DataFrame:
    """Dense float vectors; with ``n`` a column of lengths, rows of another length have a problem."""
    df = spark.read.parquet(path)
    ok = F.lit(True) if n is None else F.size(column) == F.col(n)
    return df.withColumn("problem", F.when(~ok, "shape"))


def config(spark: SparkSession, path: str) -> dict:
    """A JSON object file on any file system that Spark reads."""
    import json

    rows = spark.read.option("wholetext", "true").text(path).collect()
    return json.loads(rows[0][0])


def inside(root: str, name: str) -> str:
    """A path below root; names that lead out of it are refused."""
    parts = name.split("/")
    if name.startswith("/") or ":" in parts[0] or ".." in parts:
        raise ValueError(f"{name} leads out of {root}")
    return f"{root.rstrip('/')}/{name}"


def bucket(key, buckets: int):
    """The bucket of a key, as writers.indexed deals rows."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def rows_of(spark: SparkSession, path: str, key: str, value, buckets: int = 64) -> DataFrame:
    """The rows of one key of a table written by writers.indexed: one bucket is read, the others are pruned."""
    rows = spark.read.parquet(path)
    return rows.where((F.col("bucket") == bucket(F.lit(value), buckets)) & (F.col(key) == F.lit(value))).drop("bucket")


def one_row(rows: DataFrame, what: str):
    """The only row; none or several are an error."""
    found = rows.limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{what}: {'no row' if not found else 'several rows'}")
    return found[0]


def samples(manifest: DataFrame, files: DataFrame, split: str | None = None, domains: list[str] | None = None, limit: int | None = None, key: str = "file_id") -> DataFrame:
    """The manifest's rows of a split and of domains with their files' columns, by key; a row without a file is left out.

    ``limit`` keeps the first rows by key. Null keys meet no file.
    """
    rows = manifest
    if split is not None:
        rows = rows.where(F.col("split") == split)
    if domains is not None:
        rows = rows.where(F.col("domain").isin(domains))
    joined = rows.join(files, key).orderBy(key)
    return joined if limit is None else joined.limit(limit)


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Of each key the row that writers.upsert appended last, without deleted ones."""
    rows = spark.read.parquet(path)
    whole = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(whole, F.struct("version__", "writer__")).alias("r")).select("r.*").where("NOT deleted__").drop("version__", "writer__", "deleted__")
