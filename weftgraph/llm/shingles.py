"""Words of whole texts and sets of five-word shingles, as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SHINGLE = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xE9846AF9B1A615D)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xE9846AF9B1A615D)
    return x ^ (x >> np.uint64(28))


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, code of each word in order, offsets of the texts).

    Words are the runs of characters other than space and tab to carriage return, with A-Z
    in lower case; null texts have none.
    """
    if pa.types.is_dictionary(texts.type):
        texts = texts.dictionary_decode()
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets, values = offsets - offsets[0], lists.flatten()
    coded = values.dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy()
    empty = pc.index(words, "").as_py()
    if empty >= 0:  # from white space at an end
        full = codes != empty
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        codes = codes[full]
    return words, codes, offsets


def slices(texts: pa.Array, limit: int) -> list[pa.Array]:
    """The texts in parts of up to so many bytes (a longer text is a part by itself), to bound a worker's memory."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, lo = [], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + limit, side="right")))
        out.append(texts.slice(lo, hi - lo))
        lo = hi
    return out


def shingle_sets(texts: pa.Array, limit: int = 4_000_000) -> list[np.ndarray]:
    """Each text's set of shingles: sorted distinct hashes of five successive words, of all its words if it has fewer, empty without words."""
    return [x for part in slices(texts, limit) for x in _sets(part)]


def _sets(texts: pa.Array) -> list[np.ndarray]:
    words, codes, offsets = coded_words(texts)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))[codes]
    n = len(hashes)
    rolled = np.zeros(0, np.uint64)
    if n >= SHINGLE:
        rolled = hashes[: n - SHINGLE + 1] * _ODD[0]
        for j in range(1, SHINGLE):
            rolled = rolled + hashes[j : n - SHINGLE + 1 + j] * _ODD[j]
        rolled = mix(rolled)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix(np.array([(hashes[a:b] * _ODD[: b - a]).sum(dtype=np.uint64)], np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
