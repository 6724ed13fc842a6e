"""Helpers shared by the llm operators: word splitting, hashing, shared-folder tables.

The text helpers work on one Arrow batch inside a task; Spark owns the
partitioning, the shuffles and the recovery.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: A-Z to a-z, every other byte unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, and every ASCII byte other than a letter or digit becomes a space.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def space_words(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes; bytes.split() cuts at exactly those six bytes."""
    return utf8(text).translate(LOWER).split()


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8 bytes."""
    return utf8(text).translate(ALNUM).split()


class WordHashes(dict):
    """Remembers the 64-bit hash of each word met; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), element by element."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word windows; of the whole sequence if it is shorter; none without words."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(width, n)
    out = mix64(hashes[: n - width + 1] + np.uint64(width))
    for k in range(1, width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - width + 1 + k])
    return np.unique(out)


_cleaned: set[str] = set()
#: Tables written by ``stored``, in order.
written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session without it one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        from pathlib import Path
        from tempfile import gettempdir

        base = Path(gettempdir(), "textloom-checkpoints").as_uri()
    return f"{base.rstrip('/')}/textloom-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    top = shared_dir(spark)
    path = f"{top}/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    written.append(path)
    if top not in _cleaned:
        _cleaned.add(top)
        import atexit

        atexit.register(drop, spark, top)
    # columns are read by name, so that no job has to look into the files for their types
    return spark.read.schema(df.schema).parquet(path)


def stored_parts(spark: SparkSession, parts: Iterable[DataFrame]) -> DataFrame:
    """Tables of one schema, written one after another to one folder and read back as one table."""
    path, schema = f"{shared_dir(spark)}/{uuid.uuid4().hex}", None
    for part in parts:
        part.write.mode("append").parquet(path)
        schema = part.schema
    written.append(path)
    return spark.read.schema(schema).parquet(path)


def drop(spark: SparkSession, top: str) -> None:
    """Delete a table of ``stored``, or the folder of all."""
    jvm = spark._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    path = jvm.org.apache.hadoop.fs.Path(top)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def held_out(id_column, modulus: int, remainder: int):
    """True where crc32 of the id as text leaves ``remainder``; a null id counts as the empty text."""
    from pyspark.sql import functions as F

    return F.crc32(F.encode(F.coalesce(id_column.cast("string"), F.lit("")), "UTF-8")) % modulus == remainder


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
