"""What the operators of this subpackage share: the shared folder, written tables, checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that part words: x20 and x09 to x0D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="gleaner-")
    return _own_dir[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: nothing is left to ask
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, path)
    return path


#: Rows and bytes of an Arrow batch: texts can be long, and a worker holds a batch several times over.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("268435456", str(8 << 20))}


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, where the session still has Spark's own sizes."""
    for key, (default, own) in BATCH.items():
        if spark.conf.get(key, default) in (default, "256MB", "256m"):
            spark.conf.set(key, own)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors, is computed once.

    ``options`` are the writer's."""
    spark = df.sparkSession
    bound_batches(spark)
    path = new_path(spark, name)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[id(out)] = (out, path)
    return out


_tables: dict[int, tuple[DataFrame, str]] = {}


def forget(*tables: DataFrame) -> None:
    """Removes written tables that nothing will read any more; what was written from them stays."""
    for df in tables:
        found = _tables.pop(id(df), None)
        if found:
            _delete(df.sparkSession, found[1])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= max_rows else df


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out, k = f"_{name}", 0
    while out.lower() in taken:
        out, k = f"_{name}_{k}", k + 1
    return out


def quoted(name: str) -> str:
    """A column name as an expression reads it, whatever stands in it."""
    return "`" + name.replace("`", "``") + "`"


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8 bytes; null has none."""
    # bytes.lower() and bytes.split() touch A-Z and the six ASCII white spaces only.
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def shingles(words: list[bytes], k: int, seed: int = 0) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles; the whole sequence if it is shorter; empty without words."""
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix64(out) + h[i : len(h) - n + 1 + i]
    return np.unique(mix64(out))


def chunks(rows: Iterable, size_of, limit: int) -> Iterator[list]:
    """Lists of consecutive rows, each closed once its summed size reaches ``limit``."""
    out, total = [], 0
    for row in rows:
        out.append(row)
        total += size_of(row)
        if total >= limit:
            yield out
            out, total = [], 0
    if out:
        yield out
