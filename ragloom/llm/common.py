"""Shared plumbing: table reading, scratch tables in the cluster's shared folder, code shipping."""

from __future__ import annotations

import gc
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

CHECKPOINT_KEY = "spark.checkpoint.dir"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of this machine only where all run on it (local master)."""
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
    global _own
    if not _own:
        _own = "file://" + tempfile.mkdtemp(prefix="ragloom-")
    return _own


_own = ""


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    path = f"{shared_dir(spark)}/ragloom-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and reread it: cuts the lineage, survives lost executors.
    The table goes when the application ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    free(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._ragloom_path = path
    return out


def quoted(name: str) -> str:
    """A column's name as SQL text and `select` take it, dots and blanks included."""
    return "`" + name.replace("`", "``") + "`"


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that `df` doesn't have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        name = f"ragloom_{name}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def free(spark: SparkSession) -> None:
    """Let the driver's cleaner drop the shuffle files of finished jobs that nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(df: DataFrame) -> None:
    """Delete a table of `materialise` that no plan reads any more."""
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._ragloom_path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def ship(spark: SparkSession) -> None:
    """Send this package's source to the Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_ragloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    path = os.path.join(tempfile.mkdtemp(prefix="ragloom-src-"), "ragloom_src.zip")
    Path(path).write_bytes(buffer.getvalue())
    sc.addPyFile(path)
    sc._ragloom_shipped = True


def tidy(f):
    """`f` for mapInArrow. Its worker serves other tasks later, so at the end what `f` has freed goes back to the system."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return run


def map_rows(df: DataFrame, f, keep: list[str] | None = None) -> DataFrame:
    """`f`, as for mapInArrow, over `df`, whose columns (or those of `keep`, which are its first ones) it returns, whatever their names."""
    names, out = df.columns, keep or df.columns
    safe = [f"c{i}" for i in range(len(names))]

    def run(batches):
        for b in f(b.rename_columns(names) for b in batches):
            yield b.rename_columns(safe[: len(out)])

    schema = StructType([StructField(s, x.dataType) for s, x in zip(safe, df.schema.fields[: len(out)])])
    return df.toDF(*safe).mapInArrow(tidy(run), schema).toDF(*out)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, size: int, each: int) -> int:
    """Partitions for `size` bytes or entries: the session's number at least, and as many as `each` of them fill."""
    return max(partitions(spark), -(-int(size) // each))


#: Quantiles of an order's key that the driver may hold.
QUANTILES = 4096


def with_range(df: DataFrame, key: str, out: str, rows: int, each: int) -> DataFrame:
    """`df` with `out`: the number of the range of `key` (a long) that a row lies in, ascending with it; -1 for null. Ranges hold
    about `each` of the `rows` rows.

    Boundaries are approximate quantiles, QUANTILES at most; larger tables cut each of these ranges into equal widths. So far-off
    keys make no range larger than a QUANTILES-th of the rows, whatever the keys' distribution."""
    from pyspark.ml.feature import Bucketizer

    wanted = min(QUANTILES, max(1, -(-rows // each)))
    found = df.agg(F.percentile_approx(key, [i / wanted for i in range(wanted + 1)], max(10_000, 20 * wanted)).alias("q")).first().q
    found = [float(x) for x in found or [0]]
    ends = sorted(set(found))
    if len(ends) < 3:
        placed = df.withColumn(out, F.lit(0.0))
        ends = [ends[0], ends[-1]]
    else:
        raw = f"{out}_key"
        bucketizer = Bucketizer(splits=[float("-inf"), *ends[1:-1], float("inf")], inputCol=raw, outputCol=out, handleInvalid="keep")
        placed = bucketizer.transform(df.withColumn(raw, F.col(key).cast("double"))).drop(raw)
    place, inside = F.col(out), max(1, -(-rows // (each * wanted)))
    if inside > 1:
        at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col(out).cast("int") + 1)
        width = at([max(1.0, (b - a) / inside) for a, b in zip(ends, ends[1:])])
        part = F.floor((F.col(key).cast("double") - at(ends[:-1])) / width)
        place = place * inside + F.greatest(F.lit(0.0), F.least(F.lit(inside - 1.0), part.cast("double")))
    return placed.withColumn(out, F.when(F.col(key).isNull(), F.lit(-1)).otherwise(place).cast("long"))


def unit_interval(h):
    """A 64-bit hash as a place in [0, 1): its last six decimal digits come first, twelve more behind, so that a share of any
    size, down to single rows of 10^15, can be picked."""
    first, rest = F.pmod(h, F.lit(1_000_000)), F.pmod(F.floor(h / 1_000_000), F.lit(1_000_000_000_000))
    return (first + rest / F.lit(1e12)) / F.lit(1e6)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def pack(a: np.ndarray) -> bytes:
    """Byte planes of an array under zstandard."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def unpack(data: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).reshape(-1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over uint64 arrays (fixed multipliers of the public splitmix64 generator)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes] | list[str], seen: dict, limit: int = 400_000) -> np.ndarray:
    """64-bit hashes of words through a bounded memo (`seen`, emptied when it holds `limit` words)."""
    import xxhash

    if len(seen) > limit:
        seen.clear()
    get, out = seen.get, []
    append, digest = out.append, xxhash.xxh3_64_intdigest
    for w in words:
        h = get(w)
        if h is None:
            h = seen[w] = digest(w)
        append(h)
    return np.array(out, dtype=np.uint64)


def windows64(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of `n` consecutive word hashes."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(count, n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + count])
    return out


def crc32_sql(text: str) -> str:
    """DuckDB's expression for the unsigned crc32 of a text of ASCII characters (fixed value: the reflected polynomial); null for null."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::bigint)"
    return f"case when {text} is not null then xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: {step}), 4294967295) end"
