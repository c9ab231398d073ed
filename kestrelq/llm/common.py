"""What the operators share: input columns, the shared work folder, batches of texts."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package when the driver found it by sys.path alone."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if _ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, known) if x)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    ready(spark)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return table.select(*columns) if columns else table


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Where that is
    unset (one machine, as in tests), a folder of this machine serves and is set for the session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="kestrelq-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df, computed once into the shared folder; its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    return out


_PATHS: dict[int, tuple[weakref.ref, str]] = {}


def forget(*tables: DataFrame) -> None:
    """Removes tables that written() made and no plan still reads."""
    for df in tables:
        known, path = _PATHS.pop(id(df), (None, ""))
        if known is not None and known() is df:
            jvm = df.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def join_hubs(rows: DataFrame, single: DataFrame, key: str, weight: str, total: int, parts: int = 4096) -> DataFrame:
    """Inner join on key with a written table of one row a key, whose `weight` counts the key's rows among
    `total` rows. Keys with more than total / parts rows (256 at least) are fewer than `parts`: those are
    broadcast, so their rows stay where they are; all others are shuffled."""
    heavy = F.col(weight) > max(256, total // parts)
    hubs = single.where(heavy)
    if hubs.isEmpty():
        return rows.join(single, key)
    light = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(single.where(~heavy), key)
    return light.unionByName(rows.join(F.broadcast(hubs), key))


_HELD: dict[str, Callable[[], None]] = {}


def claim(name: str, release: Callable[[], None]) -> None:
    """Says that this process now holds a large table or cache, which release() empties; those that
    other operators left in a reused worker go first."""
    for other in [k for k in _HELD if k != name]:
        _HELD.pop(other)()
    _HELD[name] = release


def same_plan(spec: dict, plan: dict) -> bool:
    """Whether a tokenizer file prepares, splits and merges text just as `plan` says: a fast path that knows one way
    of splitting must not serve another. Tokens beside the vocabulary must stand for themselves alone."""
    plain = all(not t[k] for t in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    found = {k: spec.get(k) for k in ("normalizer", "pre_tokenizer", "post_processor")}
    found["model"] = {k: v for k, v in (spec.get("model") or {}).items() if k not in ("vocab", "merges")}
    return plain and found == plan


def slices(batches: Iterator[pa.RecordBatch], column: str, max_rows: int = 4096, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most max_rows rows and, but for a single longer text, max_bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Null texts count as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def id_bucket(id_column: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo buckets; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % buckets


def id_bucket_of(value: object, buckets: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % buckets
