"""Tables from CSV, JSON lines, JSON arrays, checkpoints and NumPy files."""
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Quoted CSV with a header; texts may hold line breaks."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """Every column a string; the empty string is null."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    return df.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in df.columns])


def read_csv_or_json(spark: SparkSession, csv_path: str, json_path: str, schema) -> DataFrame:
    """The CSV file, or the JSON array if there is none."""
    from pyspark.errors import AnalysisException
    try:
        return read_csv(spark, csv_path, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.read.schema(schema).option("multiLine", True).json(json_path)


def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines; malformed ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_checkpoint(spark: SparkSession, path: str, schema, keys, ordinal: str) -> DataFrame:
    """An append-only log of JSON lines: of each key the row of the greatest ordinal."""
    df = read_json_lines(spark, path, schema)
    w = Window.partitionBy(*keys).orderBy(F.desc(ordinal))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def newest_file(spark: SparkSession, path: str) -> DataFrame:
    """The path and time of the newest file."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return files.orderBy(F.desc("modificationTime"), "path").limit(1)


def npy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, vector) of ``.npy`` files of two dimensions; a file is read by one task, and gives rows in slices."""
    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made = np.load(io.BytesIO(content), allow_pickle=False)
                for at in range(0, len(made), 4096):
                    part = np.ascontiguousarray(made[at : at + 4096], dtype="float32")
                    vectors = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype="int32") * made.shape[1], part.ravel())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), vectors], names=["file", "n", "vector"])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return files.select("path", "content").mapInArrow(read, "file string, n long, vector array<float>")
