"""Chat formatting by columnar byte assembly.

Turns are brought together by conversation and sorted; then no string is ever built.  The bytes of
all roles and contents are laid side by side, the five segments of each turn (marker, role, line
feed, content, end) become rows of lengths and source offsets, their cumulative sums give scatter
indices, and one gather fills a preallocated Arrow buffer.

    <|im_start|>role
    content<|im_end|>

Defined results: turns go by (turn, role, text), nulls first, so ties and repeated rows have a fixed
order and all stay; a null role is ``unknown``; a null or empty text is an empty turn; rows without
conv_id belong to no conversation and are left out; markers inside a content are left as they are.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import column_bytes

START, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
_CHUNK = 1 << 14


def assemble(roles: pa.Array, texts: pa.Array, group: np.ndarray) -> pa.Array:
    """One string for each run of equal ``group`` values (0, 1, 2, ...)."""
    n = len(roles)
    fixed = np.frombuffer(START + MIDDLE + END, np.uint8)
    parts = [column_bytes(roles), column_bytes(texts)]
    source = np.concatenate([fixed, parts[0][0], parts[1][0]])
    at, size = np.zeros((n, 5), np.int64), np.zeros((n, 5), np.int64)
    size[:, 0], size[:, 2], size[:, 4] = len(START), len(MIDDLE), len(END)
    at[:, 2], at[:, 4] = len(START), len(START) + len(MIDDLE)
    base = len(fixed)
    for column, (data, offsets) in zip((1, 3), parts):
        at[:, column], size[:, column] = base + offsets[:-1], np.diff(offsets)
        base += len(data)
    at, size = at.ravel(), size.ravel()
    end = np.cumsum(size)
    total = int(end[-1]) if n else 0
    buffer = pa.allocate_buffer(total)
    scatter = np.repeat(at - (end - size), size) + np.arange(total)
    np.take(source, scatter, out=np.frombuffer(buffer, np.uint8))
    last = np.flatnonzero(np.diff(group, append=-1))
    offsets = np.concatenate([[0], end[4::5][last]])
    if total < 1 << 31:
        return pa.Array.from_buffers(pa.string(), len(last), [None, pa.py_buffer(offsets.astype(np.int32)), buffer])
    return pa.Array.from_buffers(pa.large_string(), len(last), [None, pa.py_buffer(offsets), buffer])


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, text, n_turns, n_bytes) of every conversation."""
    names = ["conv_id", "text", "n_turns", "n_bytes"]
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("raw_role"), F.col("text").alias("raw_text"))
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "raw_role", "raw_text").select("conv_id", "role", "text")

    def build(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        ids = table.column("conv_id").combine_chunks()
        new = np.ones(len(ids), bool)
        new[1:] = ~np.asarray(pa.compute.equal(ids[1:], ids[:-1]))
        first = np.flatnonzero(new)
        text = assemble(table.column("role"), table.column("text"), np.cumsum(new) - 1)
        bytes_ = pa.compute.binary_length(text).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), text.cast(pa.string()), pa.array(np.diff(first, append=len(ids))), bytes_], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(lo, _CHUNK)
                ids = part.column("conv_id")
                # the last conversation of a chunk may go on in the next
                same = np.asarray(pa.compute.equal(ids, ids[-1]))
                cut = int(np.argmax(same))
                if cut or held and held[-1].column("conv_id")[-1] != ids[-1]:
                    yield from build(pa.Table.from_batches([*held, part.slice(0, cut)]))
                    held = []
                held.append(part.slice(cut))
        if held:
            yield from build(pa.Table.from_batches(held))

    id_type = conversations.schema["conv_id"].dataType.simpleString()
    return turns.mapInArrow(run, f"conv_id {id_type}, text string, n_turns bigint, n_bytes bigint")
