"""Reading findings: declared schemas, path guard, column check, preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from defectflow.session import spread


def _strings(*names: str) -> StructType:
    return StructType([StructField(name, StringType()) for name in names])


# Column names of the input, sample and result files.
REQUIRED_COLUMNS = ("DESCRIPTION", "PRIORITY", "INITIAL RECOMMENDATION")
INPUT_SCHEMA = _strings(*REQUIRED_COLUMNS)
SAMPLE_SCHEMA = _strings(
    "NOTIFICATION", "DESCRIPTION", "PRIORITY", "INITIAL RECOMMENDATION", "State", "NEW RECOMMENDATION",
    "ENGINEERING REVIEW OUTCOMES",
)
RESULT_COLUMNS = (
    "DESCRIPTION", "PRIORITY", "INITIAL_RECOMMENDATION", "PREDICTED_RECOMMENDATION", "TOPIC_CATEGORY",
    "STRUCTURED_OUTPUT",
)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) exists on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def check_csv_path(spark: SparkSession, path: str) -> str:
    """Return the path if it exists and ends in ``.csv`` (any case), else raise."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no such file: {path}")
    if not path.rstrip("/").lower().endswith(".csv"):
        raise ValueError(f"not a CSV file: {path}")
    return path


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """Header names; reads the first line only."""
    return spark.read.option("header", True).csv(path).columns


def read_findings(spark: SparkSession, path: str, schema: StructType | None = None, multi_line: bool = True,
                  check: bool = True) -> DataFrame:
    """Findings from CSV with a header; every column is a string.

    Columns follow the header unless a schema is given. Quoted line breaks are
    kept, for which Spark reads each file in one task (rows of few files are
    then spread over the cores); pass ``multi_line=False`` for large files
    known to have one record per line.
    """
    if check:
        check_csv_path(spark, path)
    schema = schema or _strings(*csv_columns(spark, path))
    return spread(
        spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("escape", '"')
        .option("enforceSchema", False).csv(path)
    )


def validate_columns(df: DataFrame, required=REQUIRED_COLUMNS, mode: str = "exact", count_rows: bool = False):
    """``(ok, message)``: do the column names equal, or contain, the required ones?

    Rows are counted for the message only on request, since that reads the data.
    """
    have, need = set(df.columns), set(required)
    if mode == "exact":
        ok = have == need
    elif mode == "contains":
        ok = need <= have
    else:
        raise ValueError("mode must be 'exact' or 'contains'")
    if not ok:
        missing, extra = sorted(need - have), sorted(have - need)
        return False, f"expected columns {list(required)}; missing {missing}, unexpected {extra}"
    return True, f"columns are valid, {df.count()} rows" if count_rows else "columns are valid"


def normalize_findings(df: DataFrame) -> DataFrame:
    """Input columns under the names the operators use, all strings."""
    return df.select(
        F.col("DESCRIPTION").cast("string").alias("description"),
        F.col("PRIORITY").cast("string").alias("priority"),
        F.col("`INITIAL RECOMMENDATION`").cast("string").alias("initial_recommendation"),
        *[F.col(f"`{c}`") for c in df.columns if c not in REQUIRED_COLUMNS],
    )


def preview(df: DataFrame, n: int, columns: list[str], *order: str) -> DataFrame:
    """First ``n`` rows of some columns, in an explicit order."""
    return df.orderBy(*[F.col(f"`{c}`") for c in order]).select(*[F.col(f"`{c}`") for c in columns]).limit(n)
