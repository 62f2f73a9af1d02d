"""What several operators share: tables, cutting lineage, and word hashing in numpy."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are hashed at once; the arrays for it take about 40 times as much.
CHUNK = 1 << 20

_MUL, _GRAM = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the cluster names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("the cluster names no folder that driver and executors share: set spark.checkpoint.dir")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="recallspark-"))
        found = jsc.getCheckpointDir().get()
    return found


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from the shared folder, so that a lost executor costs no more than the last step."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of df."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        out.append(name)
    return out


#: Rows of an Arrow batch. Texts are long: the default of 10,000 rows takes tens of MB in the JVM and again in Python.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of BATCH_ROWS rows from now on, unless the session sets fewer."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH_ROWS:
        conf.set(_BATCH, BATCH_ROWS)
    return df


#: A table of at most so many rows, of a few numbers or short strings each, may be broadcast.
SMALL_ROWS = 200_000


def hinted(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df, read from the shared folder, marked for broadcast if a count shows that it is small; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def text_ids(docs: DataFrame, name: str) -> DataFrame:
    """docs with a long in the column `name`, the same for equal texts (null is as empty) and another for others.

    It is a 64-bit hash. Two numbers of eight bytes a text are grouped to find texts that share the hash; there all but one take another hash, so that
    two texts have the same number only if two independent hashes coincide for them.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    one, two, three = F.xxhash64(body), F.xxhash64(F.lit(1), body), F.xxhash64(F.lit(2), body)
    return numbered_apart(docs, name, one, two, three)


def numbered_apart(docs: DataFrame, name: str, one: Column, two: Column, three: Column) -> DataFrame:
    """docs with `one` in the column `name`; among rows that have it and differ in `two`, only those with the smallest keep it, and the others have `three`."""
    first, other = unused(docs, "_one", "_least")
    shared = docs.groupBy(one.alias(first)).agg(F.min(two).alias(other), F.max(two).alias("most")).where(F.col(other) != F.col("most")).drop("most")
    shared = cut(shared)
    if shared.isEmpty():
        return docs.withColumn(name, one)
    return docs.join(hinted(shared), one == F.col(first), "left").withColumn(name, F.when(two != F.col(other), three).otherwise(one)).drop(first, other)


def text_bytes(column: str = "text") -> Column:
    """The text in UTF-8; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"").cast("binary"))


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, each value to another one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x], np.uint64))[0])


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n; base is odd."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, CHUNK + 1)
        up, down = (np.full(size, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if n <= 4 * CHUNK:
            _powers[base] = have
    return have


def _table(separators: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    value = np.arange(256, dtype=np.uint64)
    if fold:
        value[65:91] += 32
    return inside, value + np.uint64(1)


#: Words end at white space.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Words end at any ASCII character that is neither letter nor digit.
NOT_ALNUM = bytes(i for i in range(128) if not chr(i).isalnum())


class Words:
    """The words of some texts: hash, start and end byte of each; at[i]:at[i + 1] are those of text i."""

    def __init__(self, texts: pa.Array, fold: bool = True, separators: bytes = SPACE):
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        base = offsets[0] if len(texts) else 0
        body = texts.buffers()[2]
        self.data = np.frombuffer(body, np.uint8)[base : offsets[-1]] if body is not None and len(texts) else np.zeros(0, np.uint8)
        self.offsets = offsets - base if len(texts) else np.zeros(1, np.int64)
        inside, value = _table(separators, fold)
        is_word = inside[self.data]
        first, last = is_word.copy(), is_word.copy()
        first[1:] &= ~is_word[:-1]
        last[:-1] &= ~is_word[1:]
        edge = self.offsets[(self.offsets > 0) & (self.offsets < len(self.data))]
        first[edge] = is_word[edge]
        last[edge - 1] = is_word[edge - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.start, self.offsets)
        up, down = powers(_MUL, len(self.data))
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(value[self.data] * up[: len(self.data)], out=total[1:])
        length = (self.end - self.start).astype(np.uint64)
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + length)

    def doc(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words by first word, and whether they are of one text."""
        n = max(0, len(self.hash) - k + 1)
        up, down = powers(_GRAM, len(self.hash))
        total = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * up[: len(self.hash)], out=total[1:])
        doc = self.doc()
        return mix((total[k : k + n] - total[:n]) * down[:n] + np.uint64(k)), doc[:n] == doc[k - 1 : k - 1 + n]


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about that many bytes each, one text at least."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + most, "right")))
        yield i, j
        i = j


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
