"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word and line contracts: space, tab, newline, vertical tab, form feed, return.
WS_CLASS = "[\\x20\\x09-\\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"
WS_BYTES = WS_CHARS.encode()

_RNG = np.random.default_rng(23)
_CHARS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[list(WS_BYTES)] = True

#: A key list is broadcast only when its measured size is below this; otherwise the join shuffles.
BROADCAST_BYTES = 8 << 20

#: ``sifted`` broadcasts a filter of so many bits a key (and filter) up to so many keys, and shuffles beyond that.
SIFT_BITS, SIFT_KEYS = 12, 1 << 26

#: Rows of a file of a narrow table whose number of rows is known before it is written.
ROWS_A_FILE = 50_000

_local_root: str | None = None
#: Paths of the tables written inside a ``scratch`` block; None outside.
_recorded: list[str] | None = None
_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where that is unset on a local master (tests)."""
    global _local_root
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="coppice-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return "file://" + _local_root


def table(df: DataFrame, name: str = "t", rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors.

    rows: how many there are at most, where that is known; a task and a file then hold about ROWS_A_FILE of them."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_A_FILE)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _recorded is not None:
        _recorded.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(docs: DataFrame):
    """Records the tables written inside; those of the block before are deleted first, but for any that ``docs`` reads.

    For stages whose results are written before the next one starts. Tables written outside such blocks stay."""
    global _recorded, _scratch
    spark = docs.sparkSession
    used = docs.inputFiles()
    for path in _scratch:
        if not any(path.rpartition("/")[2] in f for f in used):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _scratch = _recorded = []
    try:
        yield
    finally:
        _recorded = None


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keys_join(df: DataFrame, keys: DataFrame, on: str | list[str], how: str, row_bytes: int = 16, rows: int | None = None) -> DataFrame:
    """Join with a written list of keys: broadcast behind a check of its size (rows: if known), shuffled beyond that."""
    small = (keys.count() if rows is None else rows) * row_bytes <= BROADCAST_BYTES
    return df.join(F.broadcast(keys) if small else keys, on, how)


def rejoin(df: DataFrame, totals: DataFrame, on: str | list[str], how: str = "inner", row_bytes: int = 32) -> DataFrame:
    """Join rows with an aggregate by the same key. The aggregate is written first: it is broadcast if it is small;
    else both sides are shuffled for this join alone, so a hot key's rows can be split over tasks at run time."""
    return keys_join(df, table(totals, "totals"), on, how, row_bytes)


def shuffled(df: DataFrame, totals: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``rejoin`` for totals whose number grows with the rows': shuffled at every size, so that a small run does the
    work of a large one. As there, both sides are shuffled for this join alone."""
    return df.join(table(totals, "totals").hint("merge"), on, how)


def hashed(by):
    """The hash under which ``sieve`` lists rows and ``sifted`` looks them up, of these columns."""
    return F.xxhash64(*([by] if isinstance(by, str) else by))


#: Of ``__bits``, the highest 30 choose a 64-bit word, the lowest ones three bits of that word; 256 words are a row.
_MASK = "({})".format(" | ".join(f"shiftleft(1L, int(shiftright(__bits, {s}) & 63))" for s in (0, 6, 12)))


def _word(words: int) -> str:
    return f"shiftright(shiftrightunsigned(__bits, 34) * {words}L, 30)"


def sieve(keys: DataFrame, filters: int = 1) -> tuple[DataFrame, int, int]:
    """What ``sifted`` needs of ``keys``, a written list of hashes (column ``key``, see ``hashed``): a Bloom filter of
    SIFT_BITS for each key and filter, or beyond SIFT_KEYS the list itself."""
    n = keys.count()
    if n > SIFT_KEYS:
        return keys, 0, filters
    words = max(256, n * filters * SIFT_BITS // 64)
    bits = keys.select("key", F.explode(F.sequence(F.lit(1), F.lit(filters))).alias("turn")).select(F.xxhash64("key", "turn").alias("__bits"))
    bits = bits.selectExpr(f"shiftright({_word(words)}, 8) AS part", f"int({_word(words)} & 255) AS slot", f"{_MASK} AS bits")
    filled = bits.groupBy("part", "slot").agg(F.bit_or("bits").alias("bits")).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("slot", "bits"))).alias("bits"))
    return table(filled.selectExpr("part AS __part", "transform(sequence(0, 255), i -> coalesce(try_element_at(bits, i), 0L)) AS __words"), "sieve"), words, filters


def sifted(df: DataFrame, by: str | list[str], sieve: tuple[DataFrame, int, int], how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` whose hash of ``by`` is among the sieve's keys, and a few others (one in 70 for one filter, one
    in 4,000 for two). "left_anti": the rows that a sieve of one filter does not let pass.

    For what an exact step follows. No row is shuffled, and the plan is the same at every size up to SIFT_KEYS; beyond,
    it is an exact join by a shuffle."""
    found, words, filters = sieve
    df = df.withColumn("__key", hashed(by))
    if not words:
        return df.join(found.select(F.col("key").alias("__key")).hint("merge"), "__key", how).drop("__key")
    fits = F.expr(f"shiftright({_word(words)}, 8) = __part AND (__words[int({_word(words)} & 255)] & {_MASK}) = {_MASK}")
    for turn in range(1, filters + 1):
        df = df.withColumn("__bits", F.xxhash64("__key", F.lit(turn))).join(F.broadcast(found), fits, how).drop("__bits")
    return df.drop("__key")


def sized(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """``df``, marked for broadcast only if its known number of rows is small enough."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def narrowed(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator reads, under the operator's own names, so extra columns can't clash."""
    return docs.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def text_bytes(column) -> list[bytes]:
    """Arrow strings as UTF-8 bytes; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer; each salt gives another order of the values."""
    x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of a whole text's words, in their order."""
    c = np.frombuffer(text, np.uint8)
    inside = np.flatnonzero(~_SPACE[c])
    if not len(inside):
        return np.empty(0, np.uint64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(inside) > 1) + 1))
    place = np.arange(len(inside)) - np.repeat(first, np.diff(first, append=len(inside)))
    weight = _CHARS[place & 63] * (np.uint64(2) * (place >> 6).astype(np.uint64) + np.uint64(1))
    return mix(np.add.reduceat((c[inside].astype(np.uint64) + np.uint64(1)) * weight, first))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` written with a unique row number ``__rid``: ids may be null or repeat."""
    return table(docs.withColumn("__rid", F.monotonically_increasing_id()), "rows")


def entered(docs: DataFrame, id_col: str, text_col: str, rid_col: str | None, *more: str) -> DataFrame:
    """(rid, doc_id, text): the columns that operators on texts read. A new rid is only fixed once it is written."""
    rid = F.col(f"`{rid_col}`") if rid_col else F.monotonically_increasing_id()
    return docs.select(rid.alias("rid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *more)
