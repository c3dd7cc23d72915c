"""Sources and sinks: listings of media files, probe output, labelled pairs, reports; and the interface of feature extractors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of files that count as media.
SUFFIXES = ("mp4", "mkv", "avi", "mov", "wmv", "flv", "webm", "m4v", "mpg", "mpeg", "ts", "m2ts", "mts", "vob", "3gp", "ogv", "divx", "asf", "rmvb")


def listing(spark: SparkSession, targets: list[str], recursive: bool = True, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, mtime, size) of media files below folders, or of files named directly. Contents are not read: only the metadata
    columns of the file source are asked for. Missing targets and other suffixes are left out."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = spark.createDataFrame([], "path string, mtime double, size bigint")
    wanted = "|".join(suffixes)
    for target in targets:
        where = jvm.org.apache.hadoop.fs.Path(target)
        if not where.getFileSystem(conf).exists(where):
            continue
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(target)
        out = out.union(rows.select("path", F.unix_micros("modificationTime") / 1e6, F.col("length").cast("bigint")))
    return out.filter(F.lower("path").rlike(rf"\.({wanted})$")).dropDuplicates(["path"])


def contents(spark: SparkSession, target: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(target)


def labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(path_a, path_b, label) from a JSON list or a CSV file with a header."""
    if path.lower().endswith(".json"):
        rows = spark.read.schema("path_a string, path_b string, label string").json(path, multiLine=True)
    else:
        rows = spark.read.csv(path, header=True)
    return rows.select("path_a", "path_b", F.col("label").cast("string").alias("label"))


def write_report(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Report sink: JSON lines or CSV with a header."""
    if kind == "csv":
        rows.write.mode("overwrite").csv(path, header=True)
    else:
        rows.write.mode("overwrite").json(path)


def problem_export(problems: DataFrame) -> DataFrame:
    """(title, name, path, size_mb, reason) of problem files."""
    from ..functions.scalar import clean_title, file_name

    return problems.select(clean_title(F.col("path")).alias("title"), file_name(F.col("path")).alias("name"), "path", F.round(F.col("size") / 1048576.0, 1).alias("size_mb"), F.coalesce("repair_note", "error").alias("reason"))


class Featuriser(Protocol):
    """Turns one file into features; raised errors become the file's `error`."""

    version: str

    def __call__(self, path: str) -> dict: ...


def featurise(files: DataFrame, make: Callable[[], Featuriser], columns: str) -> DataFrame:
    """(path, columns, error): features of every distinct path. `make` is called once a task; a failing file gives a row with its
    error and null features, so it never fails the job. columns: DDL of the fields that the featuriser returns."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(columns)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        extract = make()
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    rows.append({"path": path, **extract(path), "error": None})
                except Exception as e:  # the file is reported, and the rest goes on
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=["path", *fields.names, "error"]).astype(object).where(lambda d: d.notna(), None)

    return files.select("path").distinct().mapInPandas(run, StructType.fromDDL(f"path string, {columns}, error string"))


def featurise_batches(files: DataFrame, make: Callable[[], Callable[[list[str]], list[dict]]], columns: str, rows: int = 256) -> DataFrame:
    """As featurise, for models that are fed batches: `make` gives a function from up to `rows` paths to as many features. A batch
    that fails is run path by path, so that only the failing files are reported."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(columns)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        extract = make()
        for batch in batches:
            paths = batch["path"].tolist()
            for part in (paths[i : i + rows] for i in range(0, len(paths), rows)):
                found = []
                try:
                    found = [{"path": p, **x, "error": None} for p, x in zip(part, extract(part), strict=True)]
                except Exception:  # one of them, or the batch as such
                    for path in part:
                        try:
                            found.append({"path": path, **extract([path])[0], "error": None})
                        except Exception as e:
                            found.append({"path": path, "error": f"{type(e).__name__}: {e}"})
                yield pd.DataFrame(found, columns=["path", *fields.names, "error"]).astype(object).where(lambda d: d.notna(), None)

    return files.select("path").distinct().mapInPandas(run, StructType.fromDDL(f"path string, {columns}, error string"))


def label_sheet(matches: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Pairs to label: per verdict the most confident ones, up to its quota; ties by pair."""
    out = None
    for verdict, n in quotas.items():
        part = matches.filter(F.col("verdict") == verdict).orderBy(F.desc("confidence"), "a", "b").limit(n)
        out = part if out is None else out.unionByName(part)
    return out
