"""What the text and vector operators share: scratch tables, word hashes, block grids."""

from __future__ import annotations

import atexit
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names. Where it is unset, a temporary one, in local mode alone: the
    executors of a cluster would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='ebbflow-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Whether a query deletes its shuffle files when it ends; else they stay until the driver's garbage is collected.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors. With ``free`` the shuffle
    files behind it go as soon as it is written."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE, None)
    if free:
        spark.conf.set(_FREE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free:
            spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a frame that ``store`` returned and no later step reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


def arrow_rows(batches: Iterable, text: str, key: str, most: int = 2_000_000) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts (null: empty) of Arrow batches, in slices of about ``most`` characters."""
    for batch in batches:
        keys, texts, n = [], [], 0
        for lo in range(0, batch.num_rows, 256):  # a batch is made Python objects a stretch at a time
            part = batch.slice(lo, 256)
            for k, t in zip(part.column(key).to_pylist(), part.column(text).to_pylist(), strict=True):
                keys.append(k)
                texts.append(t or "")
                n += len(texts[-1])
                if n >= most:
                    yield keys, texts
                    keys, texts, n = [], [], 0
        if keys:
            yield keys, texts
    release()


def release() -> None:
    """Give freed memory back at a task's end: workers live on, and their peaks would add up."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Odd multipliers, one per place in a shingle.
_PLACES = np.random.default_rng(20).integers(1 << 62, size=16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of a word, remembered for at most ``most`` words at a time."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str) -> list[str]:
    """Lower-case words: what stands between white space."""
    return text.lower().split()


def shingle_hashes(words: list[str], memory: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``width`` words; a shorter text is one run; no word, no run."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out += h[i : i + n] * _PLACES[i]
    return np.unique(mix(out))


def pack(*columns: np.ndarray) -> bytes:
    """Columns as compressed planes of bytes, the first of them sorted and as differences."""
    import zstandard

    first, parts = columns[0], []
    for c in (np.diff(first, prepend=first[:1] * 0), *columns[1:]):
        parts.append(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<q", len(first)) + b"".join(parts))


def unpack(block: bytes, columns: int) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(block)
    (n,) = struct.unpack("<q", raw[:8])
    out = [np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * 8, 8 + i * n * 8).reshape(8, n).T).view("<u8").ravel() for i in range(columns)]
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): smallest id reachable over undirected ``edges`` (a, b).

    Alternating large-star and small-star steps, each a shuffle with map-side minimum; a node's neighbours are never
    gathered, so hot nodes cost no more than others. Every round is written to the shared folder.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    e = store(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = [F.count("*"), F.bit_xor(F.xxhash64("a", "b"))]
    last = e.agg(*mark).first()
    while last[0]:
        # large star: every larger neighbour of a node goes to the smallest of its neighbourhood
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every smaller neighbour goes to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(low, "a").select(F.explode(pairs).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        new = store(small, name)
        drop_stored(e)
        e, now = new, new.agg(*mark).first()
        if now == last:
            break
        last = now
    # stars now: every node but the roots points at its root
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
