"""Feature-hashed text vectors (Weinberger et al. 2009)."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, FloatType

from pliego import constants as K


EMBEDDED = 256  # texts whose tokens are held at once
MD5_BLOCK, MD5_START = 64, (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)  # RFC 1321
MD5_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
MD5_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(MD5_BLOCK)]


def as_matrix(column: pa.Array | pa.ChunkedArray, kind: type | None = np.float64) -> np.ndarray:
    """A list column of equally long vectors as one matrix, of doubles or, without a kind, of the column's own numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    flat = flat.astype(kind) if kind else flat
    if len(column) and (pc.list_value_length(column).to_numpy(zero_copy_only=False) * len(column) != len(flat)).any():
        raise ValueError("vectors of different length")
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def as_vectors(matrix: np.ndarray) -> pa.ListArray:
    rows, width = matrix.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.astype(np.float32).ravel()))


def bucket(token: bytes) -> int:
    """First 32 bits of the md5, modulo the vector size."""
    return int.from_bytes(hashlib.md5(token).digest()[:4], "big") % K.VECTOR_BUCKETS


def buckets(ends: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The buckets of tokens that lie one after the other in a text, by the rounds of md5 on all tokens at once. Those that are
    more than one of its blocks are hashed one by one."""
    sizes = np.diff(ends)
    short = np.flatnonzero(sizes < MD5_BLOCK - 8)
    length = sizes[short]
    blocks = np.zeros((len(short), MD5_BLOCK), np.uint8)
    blocks.reshape(-1)[np.repeat(np.arange(len(short)) * MD5_BLOCK, length) + runs(length)] = text[np.repeat(ends[:-1][short], length) + runs(length)]
    blocks[np.arange(len(short)), length] = 0x80
    blocks.view("<u8")[:, -1] = length * 8
    words = np.ascontiguousarray(blocks.view("<u4").T)
    a, b, c, d = (np.full(len(short), v, np.uint32) for v in MD5_START)
    for i in range(MD5_BLOCK):
        mixed, word = [
            lambda: (d ^ (b & (c ^ d)), i), lambda: (c ^ (d & (b ^ c)), 5 * i + 1),
            lambda: (b ^ c ^ d, 3 * i + 5), lambda: (c ^ (b | ~d), 7 * i),
        ][i // 16]()
        mixed += a
        mixed += words[word % 16]
        mixed += np.uint32(MD5_ADDED[i])
        turn = MD5_TURNS[i // 16][i % 4]
        a, b, c, d = d, b + (mixed << np.uint32(turn) | mixed >> np.uint32(32 - turn)), b, c
    out = np.empty(len(sizes), np.int64)
    out[short] = (a + np.uint32(MD5_START[0])).byteswap() % K.VECTOR_BUCKETS
    for i in np.flatnonzero(sizes >= MD5_BLOCK - 8).tolist():
        out[i] = bucket(text[ends[i] : ends[i + 1]].tobytes())
    return out


def runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each of the lengths, one after the other."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def letters(text: np.ndarray) -> np.ndarray:
    """Mask of the bytes of UTF-8 text that belong to a token. The pattern is asked once per character that occurs."""
    leads = np.flatnonzero(text >= 0xC0)
    wide = text[leads].astype(np.int64)
    more = 1 + (wide >= 0xE0) + (wide >= 0xF0)
    codes = wide & (0x3F >> more)
    for i in range(1, 4):
        longer = more >= i
        codes[longer] = codes[longer] << 6 | text[leads[longer] + i] & 0x3F
    plain = np.bincount(text, minlength=256)[:128].nonzero()[0]
    kinds, which = np.unique(np.r_[plain, codes], return_inverse=True)
    kept = ~np.asarray(pc.match_substring_regex(pa.array([chr(c) for c in kinds.tolist()], pa.string()), K.TOKEN_BREAK))
    table = np.zeros(256, bool)
    table[plain] = kept[which[: len(plain)]]
    mask = table[text]
    for i in range(4):
        longer = more >= i
        mask[leads[longer] + i] = kept[which[len(plain) :]][longer]
    return mask


def counted(content: pa.Array) -> np.ndarray:
    """Token counts per text and bucket. Only distinct characters and tokens are looked at, everything else is array work."""
    lower = pc.utf8_lower(pc.fill_null(content, "").cast(pa.large_string()))
    ends = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + len(lower) + 1]
    text = np.frombuffer(lower.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    mask = letters(text)
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    first = ends[:-1][ends[:-1] < len(text)]
    begins[first] = mask[first]  # a token ends with its text
    starts, inside = np.flatnonzero(begins), np.flatnonzero(mask)
    cuts = pa.array(np.r_[np.searchsorted(inside, starts), len(inside)])
    tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, cuts.buffers()[1], pa.py_buffer(text[inside].tobytes())])
    found = tokens.dictionary_encode()
    rows = np.searchsorted(ends, starts, side="right") - 1
    held = found.dictionary
    places = np.frombuffer(held.buffers()[1], np.int64)[: len(held) + 1]
    cells = rows * K.VECTOR_BUCKETS + buckets(places, np.frombuffer(held.buffers()[2] or b"", np.uint8))[found.indices.to_numpy()]
    return np.bincount(cells, minlength=len(content) * K.VECTOR_BUCKETS).reshape(-1, K.VECTOR_BUCKETS)


@F.arrow_udf(ArrayType(FloatType()))
def _embed(content: pa.Array) -> pa.Array:
    found = [np.zeros((0, K.VECTOR_BUCKETS))]
    for at in range(0, len(content), EMBEDDED):
        counts = counted(content.slice(at, EMBEDDED)).astype(np.float64)
        norms = np.sqrt((counts**2).sum(axis=1, keepdims=True))
        found.append((counts / np.where(norms == 0, 1, norms)).astype(np.float32))
    return as_vectors(np.concatenate(found))


def embed(content: Column) -> Column:
    """Token counts by hash bucket, scaled to length 1. Narrow: no row leaves its partition, and the same function
    serves chunks and queries."""
    return _embed(content)
