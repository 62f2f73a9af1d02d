"""Frames put together in the tasks that read their lines, as far as they stand whole there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a frame that a task holds while it waits for the commit; larger frames are put together by a shuffle.
HELD_BYTES = 64 << 20
LINES = "file string, split long, line_no long, offset long, size int, mark int, line string, txId string, recordCount int, payloadDigest string, createdAt string"
SCHEMA = f"{LINES}, closed boolean, frame struct<commit_tx: string, record_count: int, said: string, same: boolean, payloads: array<string>>"


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LINES (mark: 1 begin, 2 commit, 0 payload) -> the same with closed and frame. Payloads of frames that stand whole in the batches are in their begin's row.

    A frame is whole if each of its lines begins at the byte after the line before it, so that nothing depends on how rows are dealt or put in order; all other lines stay as they are.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if pc.any(pc.greater(batch["mark"], 0)).as_py() or sum(b.nbytes for b in held) > HELD_BYTES:
            done, rest = _gathered(pa.concat_batches(held))
            held = [rest] if rest.num_rows else []
            yield done
    if held:
        done, rest = _gathered(pa.concat_batches(held))
        yield done
        if rest.num_rows:
            yield _packed(rest, np.zeros(0, int), np.zeros(0, int))


def _gathered(rows: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """-> rows with whole frames in their begins, and the lines from a last begin on whose commit may still come."""
    n = rows.num_rows
    column = lambda c: rows[c].fill_null(-1).to_numpy(zero_copy_only=False)
    mark, offset, size = column("mark"), column("offset"), column("size")
    follows = np.zeros(n, bool)
    follows[1:] = (offset[1:] == offset[:-1] + size[:-1] + 1) & (size[:-1] >= 0) & (mark[1:] >= 0) & pc.equal(rows["file"][1:], rows["file"][:-1]).fill_null(False).to_numpy(zero_copy_only=False)
    run = np.cumsum(~follows)
    begin, commit = np.flatnonzero(mark == 1), np.append(np.flatnonzero(mark == 2), n)
    end = commit[np.searchsorted(commit, begin)]
    cut = n
    if len(begin) and end[-1] == n and run[-1] == run[begin[-1]] and rows.slice(begin[-1]).nbytes <= HELD_BYTES:
        cut = begin[-1]
    whole = (end < np.append(begin[1:], n)) & (run[begin] == run[np.minimum(end, n - 1)])
    return _packed(rows.slice(0, cut), begin[whole], end[whole]), rows.slice(cut)


def _packed(rows: pa.RecordBatch, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """rows without the lines between each begin and end, which are payloads of the begin's row."""
    n, many = rows.num_rows, end - begin - 1
    steps = np.zeros(n + 1, int)
    steps[begin + 1] += 1
    steps[end] -= 1
    inside = np.cumsum(steps[:n]) > 0
    tx = rows["txId"]
    strange = ~pc.equal(tx.filter(pa.array(inside)), tx.take(pa.array(np.repeat(begin, many)))).fill_null(False).to_numpy(zero_copy_only=False)
    sums, last = np.append(0, np.cumsum(strange)), np.cumsum(many)
    at = np.full(n, -1)
    at[begin] = np.arange(len(begin))
    closed = at >= 0
    closed[end] = True
    at = at[~inside]
    first, lengths, same, ends = at >= 0, np.zeros(len(at), int), np.zeros(len(at), bool), np.zeros(len(at), int)
    lengths[first], same[first], ends[first] = many, sums[last] == sums[last - many], end
    payloads = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), rows["line"].filter(pa.array(inside)))
    of_end = [rows[c].take(pa.array(ends, mask=~first)) for c in ("txId", "recordCount", "payloadDigest")]
    frame = pa.StructArray.from_arrays([*of_end, pa.array(same), payloads], ["commit_tx", "record_count", "said", "same", "payloads"], mask=pa.array(~first))
    kept = rows.filter(pa.array(~inside))
    return pa.RecordBatch.from_arrays([*kept.columns, pa.array(closed[~inside]), frame], names=[*rows.schema.names, "closed", "frame"])
