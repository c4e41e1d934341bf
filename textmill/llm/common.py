"""Shared plumbing of the training-data operators.

Python code only ever sees Arrow buffers.  ``column_bytes`` exposes a string column as one byte
array plus offsets without copying, ``word_table`` cuts it into words and hashes them with numpy.
"""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that a worker turns into numpy arrays at once; longer texts are cut at word ends.
PIECE = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)

#: Word bytes: ASCII letters, digits, underscore, and the bytes of non-ASCII characters; but see ``word_bytes``.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
#: Everything but ASCII white space.
GRAPHIC = np.ones(256, bool)
GRAPHIC[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = False


class Words(NamedTuple):
    """Words of many texts. ``first[i]:first[i + 1]`` are the words of text i."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors through the shared folder, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    path = f"{_own_dir(spark)}.zip"
    to = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(sc._jsc.hadoopConfiguration()).create(to, True)
    out.write(packed.getvalue())
    out.close()
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


_kept: dict[object, object] = {}


def keep(key: object, make: Callable[[], object]) -> Any:
    """A value that a Python worker keeps from task to task; the tables of one operator at a time."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Give up what another operator's tasks left in this worker."""
    _kept.clear()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a temporary one only in local mode."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    configured = sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="textmill-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that a lost executor loses nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same as a Parquet table in the shared folder; see ``sweep``."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _own_dir(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/textmill-{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Remove what the operators of this application wrote; their results that are still lazy are lost."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of ids that ``without`` broadcasts, some 40 bytes each.
MAX_BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, gone: DataFrame, condition: Column) -> DataFrame:
    """Anti join that moves no document where ``gone`` (ids, already materialised) is small enough to broadcast."""
    small = gone.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, condition, "left_anti")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[at[0] : at[-1]]
    at = at - at[0]
    if column.null_count:  # Arrow allows bytes under a null; Spark writes none, other writers may
        dead = np.asarray(column.is_null())
        if (np.diff(at)[dead] > 0).any():
            return column_bytes(column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""))
    return raw, at


def row_slices(offsets: np.ndarray, cap: int = 4 * PIECE, rows: int = 1 << 15) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``cap`` bytes and at most ``rows`` rows; a longer text has a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + cap, "right")) - 1
        hi = min(n, lo + rows, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; several times as fast as hashing them."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


#: Bloom filters: bits per key and number of probes (about 1 % false positives).
_BITS, _PROBES = 10, 7


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    """Probes of each key by double hashing."""
    a, b = mix(keys.view(U64)), mix(keys.view(U64) + U64(_P)) | U64(1)
    return ((a[:, None] + np.arange(_PROBES, dtype=U64) * b[:, None]) % U64(size)).astype(np.int64)


def _filter_bits(n: int) -> int:
    return (_BITS * n + 64) // 8 * 8


def bloom_filter(keys: np.ndarray) -> bytes:
    """Filter over 64-bit keys."""
    bits = np.zeros(_filter_bits(len(keys)), bool)
    bits[_slots(keys, len(bits)).ravel()] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_contain(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """For each key, whether what the filter was made of can hold it; never wrongly False."""
    table = np.frombuffer(bits, np.uint8)
    at = _slots(keys, 8 * len(table))
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)


def filter_of(rows: DataFrame, column: str, keys: Callable[[pa.Array], np.ndarray], max_bytes: int) -> bytes | None:
    """One filter over a column of distinct values; None where it would be larger than ``max_bytes``.

    Tasks send the words of 64 bits that they set, merged by bit; ``keys`` maps the column to 64-bit keys.
    """
    limit = max_bytes * 8 // _BITS
    n = rows.limit(limit + 1).count()
    if n > limit:
        return None
    size = _filter_bits(n)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_slots(keys(batch.column(column)), size))
            word, first = np.unique(at >> 6, return_index=True)
            masks = np.bitwise_or.reduceat(U64(1) << (at & 63).astype(U64), first) if len(at) else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(masks.view(np.int64))], names=["word", "mask"])

    found = rows.select(column).mapInArrow(slots, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(-(-size // 64), U64)
    table[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(U64)
    return table.view(np.uint8)[: size // 8].tobytes()


_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        base = np.full(size, _P, U64)
        back = np.full(size, _INV, U64)
        base[0] = back[0] = 1
        _powers = np.cumprod(base, dtype=U64), np.cumprod(back, dtype=U64)
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each ``data[start:end]``; spans are sorted and don't overlap."""
    out = np.empty(len(starts), U64)
    lo = 0
    while lo < len(starts):
        begin = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, begin + PIECE, "right")))
        stop = int(ends[hi - 1])
        power, inverse = _power_tables(stop - begin + 1)
        sums = np.zeros(stop - begin + 1, U64)
        np.cumsum((data[begin:stop].astype(U64) + U64(1)) * power[: stop - begin], out=sums[1:])
        s, e = starts[lo:hi] - begin, ends[lo:hi] - begin
        out[lo:hi] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U64))
        lo = hi
    return out


#: Non-ASCII punctuation and spaces by their UTF-8: leading bytes, and the range of the last one.
_PUNCTUATION = (
    (b"\xc2", 0xA0, 0xBF),  # U+00A0 to U+00BF: no-break space, guillemets, ...
    (b"\xe2\x80", 0x80, 0xBF),  # U+2000 to U+203F: spaces, dashes, quotes, ellipsis, ...
    (b"\xe2\x81", 0x80, 0xAF),  # U+2040 to U+206F
    (b"\xe3\x80", 0x80, 0xBF),  # U+3000 to U+303F: ideographic space, comma, full stop, brackets
    (b"\xef\xbc", 0x81, 0x8F),  # U+FF01 to U+FF0F: full-width forms
    (b"\xef\xbc", 0x9A, 0xA0),  # U+FF1A to U+FF20
)
#: A character class of the same words for regular expressions.
WORD_CLASS = r"[0-9a-z_\x{80}-\x{9F}\x{C0}-\x{1FFF}\x{2070}-\x{2FFF}\x{3040}-\x{FF00}\x{FF10}-\x{FF19}\x{FF21}-\x{10FFFF}]"


def word_bytes(data: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to a letter, digit or underscore; non-ASCII characters but punctuation count as letters."""
    inside = WORD[data]
    for lead, least, most in _PUNCTUATION:
        at = np.flatnonzero(data[: len(data) - len(lead)] == lead[0])
        if len(at) and len(lead) == 2:
            at = at[data[at + 1] == lead[1]]
        if len(at):
            last = data[at + len(lead)]
            at = at[(last >= least) & (last <= most)]
            for k in range(len(lead) + 1):
                inside[at + k] = False
    return inside


def word_table(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray | None = None) -> Words:
    """Maximal runs of word bytes (or of ``letters``) in each text, none across two texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), none, none, np.zeros(len(offsets), np.int64))
    inside = word_bytes(data) if letters is None else letters[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begin[edges] = inside[edges]
    close = inside.copy()
    close[:-1] &= ~inside[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    close[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(close) + 1
    return Words(span_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, offsets))


def owners(first: np.ndarray) -> np.ndarray:
    """Index of the text that each word belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
