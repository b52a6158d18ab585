"""Text helpers shared by the operators: word rules, column expressions and written stages."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callstrata.session import checkpointed

#: What parts words: every ASCII character but digits and lower-case letters, after A-Z are lower-cased.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Byte table: breaks to a space, A-Z to a-z, all else (digits, a-z, bytes of non-ASCII characters) as it is.
WORD_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

staged = checkpointed
#: Rows of an Arrow batch where whole texts, vectors or sets go to Python and back.
BATCH = 2048


def byte_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text; none for null."""
    return text.translate(WORD_TABLE).split() if text else []


def spaced(text: Column) -> Column:
    """The words of a text, parted and enclosed by single spaces (a lone space if there are none)."""
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(" ")), BREAKS, " ")


def word_count(spaced_text: Column) -> Column:
    """Number of words of a text in the form of ``spaced``."""
    return F.length(spaced_text).cast("long") - F.length(F.replace(spaced_text, F.lit(" "), F.lit(""))).cast("long") - 1


def staged_by_few(df: DataFrame, rows: int = BATCH) -> DataFrame:
    """``staged`` for frames whose Arrow tasks get whole texts: at most ``rows`` rows a batch, as an executor holds several batches
    of each task, outside of the heap and in Python. The session's own limit is back afterwards."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    if not 0 < int(before) <= rows:
        conf.set(name, str(rows))
    try:
        return staged(df)
    finally:
        conf.set(name, before)


def sliced(batch, rows: int = 256) -> Iterator:
    """An Arrow batch or column in parts of a few rows, so that what is made of it in Python stays small however many rows it has."""
    for k in range(0, len(batch), rows):
        yield batch.slice(k, rows)


def batches_of_bytes(column) -> Iterator:
    """Python bytes (or None) of an Arrow string or binary column, without decoding it."""
    import pyarrow as pa

    for part in sliced(column):
        yield from part.cast(pa.binary()).to_pylist()


def give_back() -> None:
    """Returns the memory that this process has freed to the system; else Arrow and the C library keep it."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(task: Callable) -> Callable:
    """An Arrow task that gives the memory it has freed back to the system when it ends, as the idle worker has no use for it while
    later stages need it."""
    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        give_back()

    return run


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay."""
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
