"""Helpers shared by the text operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: White space that separates words: space and the controls from tab to carriage return.
SPACE = r"\x20\x09-\x0D"

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; a null text is empty.

    Other columns, whatever their names, never meet the operators' own.
    """
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def id_mod(id_col: Column, n: int) -> Column:
    """Fold of a row: the CRC-32 of its id as text, modulo ``n``; 0 for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % n, F.lit(0))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def hash_words(words: Sequence) -> np.ndarray:
    """A 64-bit hash of each word (bytes or str), equal in every process."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def lowered_words(text: str) -> list[bytes]:
    """Words between white space, A-Z in lower case; other letters keep their case."""
    return text.encode().lower().split()


def shingle_hashes(words: Sequence[bytes], size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; a shorter text is one run."""
    h = hash_words(words)
    if not len(h):
        return h
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, np.uint64(size))
    for i in range(size):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def map_rows(
    df: DataFrame, rows: Callable[[Iterator[dict]], Iterator[list]], schema: str,
    at_once: int = 2000,
) -> DataFrame:
    """``rows`` turns column lists of a few thousand input rows into output column lists."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(fields)

        def parts():
            for batch in batches:
                for start in range(0, batch.num_rows, at_once):
                    yield batch.slice(start, at_once).to_pydict()

        for columns in rows(parts()):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out
            )

    return df.mapInArrow(run, fields)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, verdicts: Callable[[list[str]], list[bool]], text_col: str = "text",
              at_once: int = 500) -> DataFrame:
    """The rows, all columns, whose text gets a true verdict; a null text is judged as empty."""
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                texts = [t or "" for t in part.column(place).to_pylist()]
                yield part.filter(pa.array(verdicts(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
