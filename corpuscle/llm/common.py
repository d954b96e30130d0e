"""What the operators of this package share: stage tables, id filters, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of one bitmap row built by bitmap_construct_agg (a fixed value of Spark).
BITS_PER_ROW = 32768


_own_dirs: dict[str, str] = {}
_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new local one where that is unset and all runs in this process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise RuntimeError(f"spark.checkpoint.dir is not set: executors of {master} share no local folder")
        found = _own_dirs.setdefault(app, "file://" + tempfile.mkdtemp(prefix="corpuscle-"))
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's part of the shared folder, which goes when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{shared_dir(spark)}/llm-{app}-{uuid.uuid4().hex[:8]}"
        system, target = _file_system(spark, _roots[app])
        system.mkdirs(target)
        system.deleteOnExit(target)
    return f"{_roots[app]}/{uuid.uuid4().hex}-{label}"


def stage(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends here, a lost executor costs one stage.

    by: a column whose values get folders of their own, so that reading one leaves the others alone.
    """
    bound_batches(df.sparkSession)
    path = new_path(df.sparkSession, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes a stage table that no later plan reads."""
    path = getattr(df, "_stage_path", None)
    if path:
        with contextlib.suppress(Exception):  # what stays goes with the application
            system, target = _file_system(df.sparkSession, path)
            system.delete(target, True)


#: The setting for the bytes of a batch between Spark and Python, and its value here unless the session gives one.
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)


def bound_batches(spark: SparkSession) -> None:
    """Both sides hold a batch in memory; by default one may take 10,000 texts. A smaller setting of the session's stays."""
    try:
        given = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)))
    except Exception:  # a version of Spark without the setting
        return
    if given <= 0 or given > int(_BATCH_BYTES):
        spark.conf.set(_BATCH, _BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bit(key: Column, log2_bits: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit((1 << log2_bits) - 1))


def id_bitmap(ids: DataFrame, key: str, expected: int) -> tuple[DataFrame, int]:
    """A hashed bitmap of ids[key]: at most 2**28 bits (32 MB) however many ids there are, so it may be broadcast."""
    log2_bits = min(28, max(15, int(expected * 32).bit_length()))
    bit = _bit(F.col(key), log2_bits)
    rows = (
        ids.select(bit.alias("_b"))
        .groupBy(F.shiftright("_b", 15).alias("_row"))
        .agg(F.expr(f"bitmap_construct_agg(_b % {BITS_PER_ROW})").alias("_bits"))
    )
    return rows, log2_bits


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df already has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(names: Iterable[str]) -> list[str]:
    return ["`" + n.replace("`", "``") + "`" for n in names]


def maybe_in(df: DataFrame, key: str, ids: DataFrame, ids_key: str, expected: int) -> tuple[DataFrame, str]:
    """df with a new boolean column, and its name: false only where the key is surely not among ids. df isn't shuffled."""
    rows, log2_bits = id_bitmap(ids, ids_key, expected)
    bit, row, bits, maybe = fresh(df, "_b", "_row", "_bits", "_maybe")
    rows = rows.withColumnsRenamed({"_row": row, "_bits": bits})
    marked = df.withColumn(bit, _bit(F.col(key), log2_bits)).withColumn(row, F.shiftright(bit, 15))
    joined = marked.join(F.broadcast(rows), row, "left")
    byte = F.conv(F.hex(F.expr(f"substring({bits}, cast(({bit} % {BITS_PER_ROW}) / 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr(f"cast(power(2, {bit} % 8) as int)")) != 0
    return joined.withColumn(maybe, F.coalesce(hit, F.lit(False))).select(*quoted(df.columns), maybe), maybe


def row_order(df: DataFrame) -> Column:
    """A number for each row by which rows of different contents are told apart in any run; map columns don't count."""
    return F.xxhash64(*[F.col(q) for q, (_, t) in zip(quoted(df.columns), df.dtypes) if "map<" not in t and "variant" not in t])


def without_rows(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """docs without the listed (doc_id, text_sha256, one: boolean): all rows of that id and text go, or all but one of them.

    A row is told by its id and text together, so ids that are null or repeat take no other text along. Null text
    counts as empty. Where one row stays and other columns differ, it is the one of the least row_order. Only rows that
    hit a bounded bitmap are shuffled.
    """
    key, theirs, one, row = fresh(docs, "_key", "_theirs", "_one", "_whole")

    def told(sha):
        return F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), sha)

    listed = stage(listed.select(told(F.col("text_sha256")).alias(theirs), F.col("one").alias(one)), "listed")
    n, ones = listed.agg(F.count(F.lit(1)), F.count_if(F.col(one))).first()
    if n == 0:
        return docs
    marked, maybe = maybe_in(docs.withColumn(key, told(F.sha2(F.coalesce("text", F.lit("")), 256))), key, listed, theirs, n)
    columns = quoted(docs.columns)
    rest = marked.where(maybe)
    out = marked.where(~F.col(maybe)).select(*columns).unionByName(rest.join(listed, F.col(key) == F.col(theirs), "left_anti").select(*columns))
    if ones:
        single = rest.join(listed.where(one), F.col(key) == F.col(theirs), "left_semi").groupBy(key)
        single = single.agg(F.min_by(F.struct(*columns), row_order(docs)).alias(row))
        out = out.unionByName(single.select(*[F.col(row)[c].alias(c) for c in docs.columns]))
    return out


#: Rows and bytes of text that a Python function works on at a time, whatever the size of an Arrow batch.
SLICE_ROWS, SLICE_BYTES = 1024, 8 << 20


def give_back() -> None:
    """Returns freed memory to the system: workers stay for later stages, and many share a machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Bytes of batches after which a worker gives freed memory back; each time costs the pages anew.
GIVEN_BACK = 48 << 20


def slices(batches: Iterable[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about size bytes at most; freed memory goes back to the system now and then, and at the end."""
    pa.set_memory_pool(pa.system_memory_pool())  # the C library's, whose freed memory can be given back
    read = 0
    for batch in batches:
        step = max(1, min(SLICE_ROWS, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        read += batch.nbytes
        del batch
        if read > GIVEN_BACK:
            give_back()
            read = 0
    give_back()


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each string, null as empty."""
    out = column.cast(pa.large_binary()).to_pylist()
    return [x or b"" for x in out]


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + len)."""
    total = int(lens.sum())
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(total)


def _words_of(kept: bytes) -> bytes:
    """A table for bytes.translate: A-Z as a-z, what is kept and all bytes of characters beyond ASCII as they are, others as blanks."""
    table = bytearray(b" " * 128) + bytearray(range(128, 256))
    for byte in kept:
        table[byte] = byte
    table[ord("A") : ord("Z") + 1] = b"abcdefghijklmnopqrstuvwxyz"
    return bytes(table)


#: Words of the letters a-z (A-Z lower-cased) and all characters beyond ASCII, without and with the digits 0-9.
LETTERS = _words_of(b"abcdefghijklmnopqrstuvwxyz")
LETTERS_AND_DIGITS = _words_of(b"abcdefghijklmnopqrstuvwxyz0123456789")


def word_runs(data: bytes, table: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text by a table of _words_of, in lists of about size bytes, so that no text is held as words whole."""
    data = data.translate(table)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end
