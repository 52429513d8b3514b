"""Vectorised text primitives shared by the corpus operators.

Everything works on an Arrow string column at once: the UTF-8 bytes of a batch
are one numpy array, words are found by a byte table, and a word's hash is a
difference of prefix sums, so no Python object is made for a word.

A *word* is a maximal run of characters that are not separators. Separators
are the ASCII characters other than letters and digits, U+0080-U+00BF (but for
the ordinal signs and the micro sign), General Punctuation U+2000-U+206F and
U+3000-U+303F. Words are compared in lower case.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_SEP = np.ones(256, dtype=bool)
_SEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i mod 2**64`` for i < n (cached, grown by doubling)."""
    have = _POWERS.get(base)
    if have is None:
        have = np.ones(1, dtype=np.uint64)
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``data[s:e]`` for each span, by prefix sums modulo 2**64.

    The powers restart every 2**20 positions, so that the tables stay small
    whatever the batch; a span that crosses a restart is hashed on its own.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    block = 1 << 20
    up, down = powers(_BASE, block + 1), powers(_INV, block + 1)
    which = starts // block
    cuts = np.flatnonzero(np.diff(which)) + 1
    for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(starts)], strict=True):
        if lo == hi:
            continue
        at = int(which[lo]) * block
        piece = data[at : at + block].astype(np.uint64)
        piece += np.uint64(1)
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(piece * up[: len(piece)], out=sums[1:])
        s, e = starts[lo:hi] - at, ends[lo:hi] - at
        over = e > len(piece)
        h = (sums[np.minimum(e, len(piece))] - sums[s]) * down[s]
        for i in np.flatnonzero(over):
            own = data[starts[lo + i] : ends[lo + i]].astype(np.uint64) + np.uint64(1)
            h[i] = np.sum(own * powers(_BASE, len(own)), dtype=np.uint64)
        out[lo:hi] = h
    out += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)


@dataclass
class Words:
    """The words of a batch: word i of document d has ``first[d] <= i < first[d + 1]``.

    ``starts`` and ``ends`` are byte offsets into ``data``; document d's text
    begins at byte ``base[d]``.
    """

    first: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    base: np.ndarray
    data: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`utf8`, in lower case with the byte offsets of the original, character by character.

    The rare letters whose lower case has another length in UTF-8 stay as they are.
    """
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    low = pc.utf8_lower(column)
    base, data = utf8(column)
    to, new = utf8(low)
    odd = np.diff(base) != np.diff(to)
    if len(data) == len(new):
        # letters that grow and letters that shrink can make up for each other
        moved = np.flatnonzero(((data & 0xC0) == 0x80) != ((new & 0xC0) == 0x80))
        odd[np.unique(np.searchsorted(base, moved, side="right") - 1)] = True
        if not odd.any():
            return to, new
    else:
        for d in np.flatnonzero(~odd).tolist():
            odd[d] = _moved(data[base[d] : base[d + 1]], new[to[d] : to[d + 1]])
    texts = low.to_pylist()
    for d in np.flatnonzero(odd).tolist():
        texts[d] = "".join(x if len(x.encode()) == len(c.encode()) else c for c in column[d].as_py() for x in (c.lower(),))
    return utf8(pa.array(texts, pa.large_string()))


def _moved(old: np.ndarray, new: np.ndarray) -> bool:
    """Whether characters of texts of one length begin at other bytes."""
    return bool((((old & 0xC0) == 0x80) != ((new & 0xC0) == 0x80)).any())


def separators(data: np.ndarray) -> np.ndarray:
    """Mask of the bytes that belong to separators."""
    sep = _SEP[data]
    n = len(data)
    for i in np.flatnonzero((data == 0xC2) | (data == 0xE2) | (data == 0xE3)):
        if data[i] == 0xC2:
            if i + 1 < n and data[i + 1] not in (0xAA, 0xB5, 0xBA):
                sep[i : i + 2] = True
        elif i + 2 < n and ((data[i] == 0xE2 and data[i + 1] in (0x80, 0x81)) or (data[i] == 0xE3 and data[i + 1] == 0x80)):
            sep[i : i + 3] = True
    return sep


def words(column: pa.Array) -> Words:
    """Words of every text of the column, with hashes of their lower case."""
    base, data = lowered(column)
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~separators(data)
    left, right = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    # a text's end is a word's end too
    inner = base[(base > 0) & (base < n)]
    cut = inner[inside[1:-1][inner] & inside[1:-1][inner - 1]] if n else inner
    left[cut] = True
    right[cut - 1] = True
    starts, ends = np.flatnonzero(left), np.flatnonzero(right) + 1
    first = np.searchsorted(starts, base)
    return Words(first, span_hashes(data, starts, ends), starts, ends, base, data)


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of ``units[i:i + k]`` for each i (k - 1 fewer than units)."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    if k <= 8:
        for j in range(k):
            out += units[j : j + n] * np.uint64(pow(_BASE, j, 1 << 64))
        return mix(out)
    block = 1 << 20
    up, down = powers(_BASE, block + k), powers(_INV, block)
    for at in range(0, n, block):
        m = min(block, n - at)
        sums = np.zeros(m + k, dtype=np.uint64)
        np.cumsum(units[at : at + m + k - 1] * up[: m + k - 1], out=sums[1:])
        out[at : at + m] = (sums[k : k + m] - sums[:m]) * down[:m]
    return mix(out)


def _sliding(x: np.ndarray, w: int, op: np.ufunc, pad: int) -> np.ndarray:
    """op over ``x[i:i + w]`` for each i; beyond the end counts as pad."""
    x = np.concatenate([x, np.full(w - 1, pad, dtype=x.dtype)])
    size = 1
    while size * 2 <= w:
        x = op(x[:-size], x[size:])
        size *= 2
    rest = w - size
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def winnow(units: np.ndarray, first: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed anchors: (positions in units, hashes of the k-grams there).

    Every run of ``w`` consecutive k-grams of a document has its minima chosen
    (all of them where there are ties), so any run of ``w + k - 1`` units that
    two documents share has a common anchor. A document with fewer than w
    k-grams has the minima of all of them.
    """
    grams = gram_hashes(units, k)
    n = len(grams)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    count = np.diff(first)
    if n == 0:
        return np.zeros(0, np.int64), grams
    last = np.repeat(first[1:], count)[:n]
    valid = np.arange(n) + k <= last
    grams = np.where(valid, np.minimum(grams, top - np.uint64(1)), top)
    low = _sliding(grams, w, np.minimum, int(top))
    begin = np.repeat(first[:-1], count)[:n]
    whole = np.arange(n) + w + k - 1 <= last
    short = (np.arange(n) == begin) & ~whole & valid
    low = np.where(whole | short, low, np.uint64(0))
    high = _sliding(low[::-1], w, np.maximum, 0)[::-1]
    at = np.flatnonzero(valid & (high == grams))
    return at, grams[at]
