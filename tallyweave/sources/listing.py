"""Which files of a feed folder are read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F

LOCK_PREFIX = "~$"  # left behind by office programs

_LISTED = "path string, length bigint"


@dataclass(frozen=True)
class Files:
    """Files of a feed: a folder with a name pattern, or paths a caller has already.

    A folder stays one; its files are listed by the scan that reads them.
    """

    source: str | list[str]
    pattern: str | None = None

    @classmethod
    def of(cls, files: Files | Sequence[str]) -> Files:
        return files if isinstance(files, Files) else cls(list(files))

    @classmethod
    def under(cls, spark: SparkSession, folder: str, *patterns: str, required: bool = True) -> Files | None:
        """The files of a folder that match a pattern; ``None``, or an error, where there are none."""
        if list_inputs(spark, folder, *patterns).isEmpty():
            if required:
                raise FileNotFoundError(f"no {' or '.join(patterns)} in {folder}")
            return None
        return cls.matching(folder, *patterns)

    @classmethod
    def matching(cls, folder: str, *patterns: str) -> Files:
        return cls(folder, _either(patterns))

    def reader(self, spark: SparkSession) -> DataFrameReader:
        return spark.read.option("pathGlobFilter", self.pattern) if self.pattern else spark.read

    def kept(self) -> Column:
        return ~F.startswith(F.col("_metadata.file_name"), F.lit(LOCK_PREFIX))

    def contents(self, spark: SparkSession) -> DataFrame:
        """Path and content of each file, a file being one row; tasks get them dealt out by size."""
        rows = self.reader(spark).format("binaryFile").load(self.source)
        return rows.where(self.kept()).select("path", "content")


def _either(patterns: Sequence[str]) -> str:
    return patterns[0] if len(patterns) == 1 else "{" + ",".join(patterns) + "}"


def list_inputs(spark: SparkSession, folder: str, *patterns: str) -> DataFrame:
    """``path, length`` of the files that match a pattern, lock files left out.

    The listing stays a frame, and no file is opened.  An absent folder holds nothing.
    """
    try:
        found = (spark.read.format("binaryFile").option("pathGlobFilter", _either(patterns))
                 .load(folder).select("path", "length"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LISTED)
    return found.where(~F.startswith(F.element_at(F.split("path", "/"), -1), F.lit(LOCK_PREFIX)))


def with_source_file(df: DataFrame, name: str = "source_file") -> DataFrame:
    """Tag rows of a file scan with the name of the file they came from."""
    return df.withColumn(name, F.col("_metadata.file_name"))


def sample_scan(df: DataFrame, n: int = 5, order: Sequence[str] = ()) -> DataFrame:
    """A few rows: the first in the given order, or any, with the limit in the scan."""
    return (df.orderBy(*order) if order else df).limit(n)
