"""What the training-data operators share: tables, shared storage, vectorised hashing of words."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: documents can be long, and a batch is held by the JVM and by a Python worker.
BATCH = 1_000
#: Above so many ids a filter by id is a shuffle join instead of a broadcast one (16 bytes an id: 16 MB at most).
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (tests, local mode)."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='proofmill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after its session's Arrow batches are set to at most BATCH rows; a lower setting stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH:
        conf.set(name, str(BATCH))
    return df


def release() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """A task's function, after whose last batch the worker releases memory: workers wait for their next task beside busy ones."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def stored(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared folder and reread: cuts the lineage and outlives executors. The table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/proofmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001  the JVM may have gone before us
        pass


def with_ids(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of df whose id is in ids (a small stored table): broadcast up to BROADCAST_IDS ids, a shuffle join beyond."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, column, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of df whose id isn't in ids (a small stored table), as with_ids; rows with a null id stay."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, column, "left_anti")


def one_per_id(documents: DataFrame) -> DataFrame:
    """doc_id and text of documents. Rows with a null doc_id are left out; of rows with the same doc_id the least text counts.
    Where no doc_id comes twice, which one aggregate over ids tells, texts aren't shuffled."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    if not docs.groupBy("doc_id").count().where("count > 1").take(1):
        return docs
    return stored(docs.groupBy("doc_id").agg(F.min("text").alias("text")))


def by_row(documents: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(documents), where each row is a document of its own: if a doc_id is null or comes twice, all rows are numbered in
    the order of doc_id (null last) and text meanwhile. work returns the columns that it gets."""
    ids = documents.groupBy(F.col("doc_id").cast("long").alias("id")).count()
    if not ids.where("id is null or count > 1").take(1):
        return work(documents)
    own, place = f"id_{uuid.uuid4().hex}", f"place_{uuid.uuid4().hex}"
    rows = documents.withColumns({own: F.col("doc_id"), place: F.monotonically_increasing_id()})
    rows = rows.orderBy(F.col("doc_id").cast("long").asc_nulls_last(), F.col("text").cast("string"), place).drop(place)
    rows = stored(rows.withColumn("doc_id", F.monotonically_increasing_id()))
    return work(rows).select(*[F.col(own).alias(c) if c == "doc_id" else c for c in documents.columns])


# ---------------------------------------------------------------- words and their hashes

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK = 1 << 18
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D | 1
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if len(_powers.get("up", ())) <= n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(n + 1, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which `span` takes the hash of any stretch of data."""
    up, _ = powers(max(CHUNK, len(data)))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(CHUNK)
    return mixed((sums[end] - sums[start]) * down[start])


#: Words are told apart by polynomials modulo two primes: modulo a power of two there are different words of a thousand
#: letters with equal hashes for every base.
PRIMES, _BASES = (2**31 - 1, 2**31 - 19), (1_103_515_245, 1_812_433_253)
_SUMMED = 1 << 22  # so many terms below 2**40 stay below 2**63
_prime_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _powers_of(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * pow(base, done, prime) % prime
        done += more
    return out


def prime_powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime base**i and base**-i for i up to n."""
    if not _prime_powers or len(_prime_powers[0][0]) <= n:
        _prime_powers[:] = [(_powers_of(b, p, n + 1), _powers_of(pow(b, -1, p), p, n + 1)) for b, p in zip(_BASES, PRIMES, strict=True)]
    return _prime_powers


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch [start, end) of data, the same wherever its bytes stand."""
    halves, letters = [], data.astype(np.int64) + 1
    for (up, down), prime in zip(prime_powers(max(CHUNK, len(data))), PRIMES, strict=True):
        sums = np.zeros(len(data) + 1, np.int64)
        for a in range(0, len(data), _SUMMED):
            b = min(len(data), a + _SUMMED)
            np.cumsum(letters[a:b] * up[a:b], out=sums[a + 1 : b + 1])
            sums[a + 1 : b + 1] += sums[a] % prime
        halves.append((sums[end] - sums[start]) % prime * down[start] % prime)
    return mixed((halves[0].astype(np.uint64) << _U(31)) ^ halves[1].astype(np.uint64))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column, end to end, and where each row begins (and the last ends); null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; rows end words as white space does."""
    solid = ~SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = at[(at > 0) & (at < len(data))]
    begins[edges] = solid[edges]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[edges - 1] = solid[edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def row_slices(at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of about `limit` bytes together; a longer row stands alone."""
    a = 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + limit, "right")) - 1)
        yield a, b
        a = b


def hashed_words(column: pa.Array, fold: np.ndarray = LOWER) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words) for every row, words being runs of other bytes than ASCII white space, after bytes are
    replaced by the table `fold`."""
    data, at = text_buffer(column)
    for a, b in row_slices(at):
        part, own = data[at[a] : at[b]], at[a : b + 1] - at[a]
        if b == a + 1 and len(part) > CHUNK:
            yield a, _long_row(fold[part])
            continue
        part = fold[part]
        start, end = word_spans(part, own)
        words = word_hashes(part, start, end) if len(start) else np.zeros(0, np.uint64)
        cut = np.searchsorted(start, own)
        for k in range(b - a):
            yield a + k, words[cut[k] : cut[k + 1]]


def _long_row(data: np.ndarray) -> np.ndarray:
    """As hashed_words for one long row, in pieces that end at white space."""
    found, a = [], 0
    while a < len(data):
        b = min(len(data), a + CHUNK)
        if b < len(data) and len(gaps := np.flatnonzero(SPACE[data[a:b]])):
            b = a + int(gaps[-1]) + 1
        elif b < len(data):  # one word longer than a chunk
            rest = np.flatnonzero(SPACE[data[b:]])
            b = b + int(rest[0]) + 1 if len(rest) else len(data)
        part = data[a:b]
        start, end = word_spans(part, np.array([0, len(part)]))
        if len(start):
            found.append(word_hashes(part, start, end))
        a = b
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


_TURN = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """A hash for each run of k words; of all words, if there are fewer; none without words."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k, n = min(k, n), n - min(k, n) + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out += words[i : i + n] * _TURN[i]
    return mixed(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each value once."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
