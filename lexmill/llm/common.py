"""What several of these operators share: reading tables, shared intermediate tables, byte tools."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a regular-expression class and as bytes.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh() -> str:
    """The start of a column name that no table has."""
    return f"_{uuid.uuid4().hex[:12]}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and has no other executors."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("lexmill.shared.dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            found = f"file://{tempfile.mkdtemp(prefix='lexmill-')}"
            spark.conf.set("lexmill.shared.dir", found)
    return found.rstrip("/")


class Scratch:
    """Intermediate tables in the shared folder, so that lost executors cost no recomputation of earlier steps.

    ``drop`` removes the tables that no later plan reads; the rest stay as checkpoint files do.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.top}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()  # Spark removes shuffle files once the driver has collected what refers to them


def empty_text(c: str = "text") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def crc_mod(c: str, m: int) -> Column:
    """crc32 of the value as text, modulo m; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % m


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "")


# --- bytes of an Arrow column as numpy arrays -------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE_BYTES)] = True


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches, most: int = 8 << 20):
    """Record batches cut so that each holds about ``most`` bytes (a longer row stays whole)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = b.nbytes
        step = max(1, int(b.num_rows * most / max(size, 1)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``buf``, and the row of each; rows are kept apart."""
    n = len(buf)
    word = np.empty(n + 2, dtype=bool)
    word[0] = word[-1] = False
    np.logical_not(IS_SPACE[buf], out=word[1:-1])
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    start = word[1:-1] & ~word[:-2]
    end = word[1:-1] & ~word[2:]
    start[inner] = word[1:-1][inner]
    end[inner - 1] = word[1:-1][inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits, in place."""
    h ^= h >> np.uint64(30)
    h *= M2
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes at a time over all spans together."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    lanes = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    length = (ends - starts).astype(np.int64)
    h = mix(length.astype(np.uint64) * M1 + np.uint64(seed))
    live, at, left = np.arange(len(starts)), starts.astype(np.int64), length
    while len(live):
        keep = left > 0
        if not keep.all():
            live, at, left = live[keep], at[keep], left[keep]
            if not len(live):
                break
        lane = lanes[at].copy()
        short = left < 8
        lane[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        h[live] = mix((h[live] ^ lane) * M1)
        at, left = at + 8, left - 8
    return h


def pack(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(x: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(x[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(x[8:], n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind)
