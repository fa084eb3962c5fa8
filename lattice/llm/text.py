"""Texts of Arrow batches as flat byte arrays, and their words as 64-bit hashes.

A batch's text column is already one buffer of UTF-8 bytes with offsets, so words are found with a
few passes of table look-ups over that buffer instead of a Python object for each word. Null texts
count as empty ones. Blocks of about ``BLOCK`` bytes bound the memory of the passes; a longer text
is a block of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U64 = np.uint64

_b = np.arange(256)
LOWER = np.where((_b >= 65) & (_b <= 90), _b + 32, _b).astype(np.uint8)
#: Words of letters and digits: every byte but ASCII that is neither a digit nor a letter (after LOWER).
ALNUM = ((_b >= 48) & (_b <= 57)) | ((_b >= 97) & (_b <= 122)) | (_b >= 128)
#: Words between white space: every byte but space and \t \n \v \f \r.
GRAPH = ~((_b == 32) | ((_b >= 9) & (_b <= 13)))

LONG = 1024  # bytes beyond which a span is hashed by itself
_LANE_MASK = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], U64)
_STEP = U64(0x9E3779B97F4A7C15)


def lanes_of(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one little-endian number; zeros follow the buffer."""
    data = np.zeros(len(buf) + 8, np.uint8)
    data[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", data, strides=(1,))


def lane(lanes: np.ndarray, starts: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """The k-th eight bytes of spans that have any there, cut off where the span ends."""
    return lanes[starts + 8 * k] & _LANE_MASK[np.minimum(size - 8 * k, 8)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash depend on all bits of its input."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column, without a copy where nothing is null."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about BLOCK bytes."""
    if not batch.num_rows:
        return
    buf, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1)
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans(buf: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each text's words begin among them (one more than texts)."""
    inside = member[buf]
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = offsets[(offsets < len(buf))]
    first[at] = inside[at]
    at = offsets[offsets > 0] - 1
    last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, eight bytes a step.

    Each step is bijective in the bytes it takes and in the hash so far, so two spans of one length of up
    to eight bytes never meet, and no family of texts has sums that cancel. Spans of more than LONG bytes
    go through BLAKE2.
    """
    if not len(starts):
        return np.zeros(0, U64)
    size = np.asarray(ends) - starts
    lanes = lanes_of(buf)
    out = mix(mix(size.astype(U64) * _STEP + U64(1)) ^ lane(lanes, starts, size, 0))
    at, k = np.flatnonzero((size > 8) & (size <= LONG)), 1
    while len(at):
        out[at] = mix(out[at] * _STEP + lane(lanes, starts[at], size[at], k))
        k += 1
        at = at[size[at] > 8 * k]
    for n in np.flatnonzero(size > LONG).tolist():
        out[n] = int.from_bytes(hashlib.blake2b(buf[starts[n] : starts[n] + size[n]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(buf: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a block, and where each text's words begin."""
    low = LOWER[buf]
    starts, ends, at = spans(low, offsets, member)
    return span_hashes(low, starts, ends), at


def words_of(text: str | None, member: np.ndarray) -> np.ndarray:
    """Hashes of one text's lower-cased words."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    return words(data, np.array([0, len(data)]), member)[0]
