"""Inversion of token lists in a task, span by span."""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Travels to the executors by value, so that they need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Stands between the columns of an index row, so that no phrase runs across.
EDGE = "\u0001"
SCHEMA = "span long, term string, at array<int>, tf array<int>, most int, shortest int, positions array<int>, docs array<struct<at: int, node_id: string, project_id: string, size: int>>"


#: What becomes of a byte of a plain text: a letter or digit stays, in lower case, as EDGE does; all else parts tokens.
_PLAIN = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" + EDGE else b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for b in range(256))


def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (span, at, node_id, project_id, and either plain, an ASCII text with EDGE between columns, or toks) in order of spans: each span's blocks, and a row of its documents without a term."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            first, spans = held[0]["span"][0].as_py() if held else batch["span"][0].as_py(), batch["span"].to_numpy()
            n = int(np.searchsorted(spans, first, "right"))
            if n:
                held.append(batch.slice(0, n))
            if n < batch.num_rows:
                yield _span_blocks(pa.Table.from_batches(held))
                held = []
            batch = batch.slice(n)
    if held:
        yield _span_blocks(pa.Table.from_batches(held))


def _token_lists(plain: pa.StringArray, toks: pa.ListArray) -> pa.ListArray:
    """The tokens of every row; those of plain texts are parted here, as the index's patterns would."""
    is_plain = pc.is_valid(plain).to_numpy(zero_copy_only=False)
    texts, others = plain.drop_null(), toks.filter(pa.array(~is_plain)).cast(pa.list_(pa.string()))
    if not len(texts):
        return others
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2])[offsets[0] : offsets[-1]].tobytes().translate(_PLAIN)
    texts = pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data))
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts)).cast(pa.list_(pa.string()))
    if not len(others):
        return lists
    return pa.concat_arrays([lists, others]).take(pa.array(np.argsort(np.argsort(~is_plain, kind="stable"))))


def _span_blocks(rows: pa.Table) -> pa.RecordBatch:
    """The inversion of one span: tokens as numbers, in order of token, row and position."""
    lists = _token_lists(rows["plain"].combine_chunks(), rows["toks"].combine_chunks())
    lengths, at = pc.list_value_length(lists).to_numpy(), rows["at"].to_numpy()
    coded = lists.flatten().dictionary_encode()
    code, sizes = coded.indices.to_numpy(), (lengths - 2).astype(np.int32)
    row, pos = np.repeat(np.arange(len(at)), lengths), np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    kept = np.flatnonzero(code != coded.dictionary.index(EDGE).as_py())
    kept = kept[np.argsort(code[kept].astype(np.min_scalar_type(len(coded.dictionary))), kind="stable")]
    code, row, pos = code[kept], row[kept], pos[kept].astype(np.int32)
    starts = lambda *columns: np.flatnonzero(np.concatenate([np.ones(min(len(columns[0]), 1), bool), functools.reduce(np.logical_or, (c[1:] != c[:-1] for c in columns))]))
    posting = starts(code, row)  # where a row's positions of a token begin, and where a token's rows do
    block = starts(code[posting])
    ends = np.append(posting, len(code))
    lists_of = lambda values, offsets: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
    by_block = lambda values: lists_of(values, np.append(block, len(posting)))
    docs = pa.StructArray.from_arrays([pa.array(at, pa.int32()), *(rows[c].combine_chunks() for c in ("node_id", "project_id")), pa.array(sizes)], ["at", "node_id", "project_id", "size"])
    tf, size = np.diff(ends), sizes[row[posting]]
    extreme = lambda ufunc, values: pa.array(ufunc.reduceat(values, block) if len(block) else values[:0], pa.int32())
    made = [
        coded.dictionary.take(pa.array(code[posting][block])), by_block(at[row[posting]]), by_block(tf), extreme(np.maximum, tf), extreme(np.minimum, size),
        lists_of(pos, ends[np.append(block, len(posting))]), pa.nulls(len(block), pa.list_(docs.type)),
    ]
    made = [pa.concat_arrays([c, pa.nulls(1, c.type)]) for c in made[:-1]] + [pa.concat_arrays([made[-1], pa.ListArray.from_arrays([0, len(at)], docs)])]
    return pa.RecordBatch.from_arrays([pa.repeat(rows["span"][0], len(block) + 1), *made], ["span", "term", "at", "tf", "most", "shortest", "positions", "docs"])
