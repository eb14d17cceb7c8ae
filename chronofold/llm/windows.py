"""Anchors of fixed-length windows: what repeated-window operators share.

A window of n symbols holds several grams of k symbols; the one with the smallest hash is its anchor. Equal windows have
equal anchors, so whatever repeats meets under one anchor, and about 2 in n - k + 2 grams are anchors at all. Hashes are
sums over powers of an odd number modulo 2**64, taken for all positions at once; they choose anchors and never decide
whether texts are equal.
"""

from __future__ import annotations

import numpy as np

_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xC2B2AE3D27D4EB4F}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}

SPACES = bytes(range(9, 14)) + b" "
_TO_SPACE = bytes.maketrans(SPACES, b" " * len(SPACES))


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, at least n of them."""
    if kind not in _POWERS or len(_POWERS[kind][0]) < n:
        base = _BASES[kind]
        size = 1 << max(n, 1 << 12).bit_length()
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.ones(1, np.uint64)
            step = b
            while len(table) < size:
                table = np.concatenate((table, table * np.uint64(step)))
                step = step * step % (1 << 64)
            tables.append(table)
        _POWERS[kind] = tuple(tables)
    return _POWERS[kind]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sums(symbols: np.ndarray, kind: str) -> np.ndarray:
    """Running sums of symbols times powers; the first is 0."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * _powers(kind, len(symbols))[0][: len(symbols)], out=out[1:])
    return out


def spans_hash(running: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
    """A hash of the symbols of each span, the same wherever they stand."""
    return mixed((running[ends] - running[starts]) * _powers(kind, len(running))[1][starts] + (ends - starts).astype(np.uint64))


def grams(symbols: np.ndarray, k: int, kind: str) -> np.ndarray:
    """The hash of every k symbols in a row."""
    running = sums(symbols, kind)
    n = max(0, len(symbols) - k + 1)
    return mixed((running[k : k + n] - running[:n]) * _powers(kind, n)[1][:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every width values in a row."""
    if len(x) < width:
        return x[:0]
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def window_anchors(symbols: np.ndarray, doc: np.ndarray, window: int, k: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of the window that starts at each symbol, and whether the window lies in one document."""
    n = max(0, len(symbols) - window + 1)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    anchors = sliding_min(grams(symbols, k, kind), window - k + 1)[:n]
    return anchors, doc[:n] == doc[window - 1 : window - 1 + n]


def runs(anchors: np.ndarray, wanted: np.ndarray, doc: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of every run of wanted windows of one document with one anchor, longest windows at most."""
    n = len(anchors)
    at = np.flatnonzero(wanted)
    if not len(at):
        return at, at
    new = np.r_[True, (np.diff(at) > 1) | (anchors[at[1:]] != anchors[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])]
    first = at[new]
    last = at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]]
    counts = (last - first) // longest + 1
    begins = np.repeat(first, counts) + longest * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    return begins, np.minimum(begins + longest - 1, np.repeat(last, counts))


class Words:
    """The words of some texts: where each lies in the canonical text (single blanks), its document and its hash."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" ".join(texts).translate(_TO_SPACE) + b" ", np.uint8)
        blank = raw == 32
        keep = ~(blank & np.r_[True, blank[:-1]])
        edge = np.flatnonzero(np.diff(np.r_[True, blank].astype(np.int8)))
        raw_starts = edge[::2]
        place = np.cumsum(keep) - keep
        self.starts, self.ends = place[raw_starts], place[edge[1::2]]
        self.canon = raw[keep]
        bounds = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.doc = np.searchsorted(bounds, raw_starts, "right")
        self.hashes = spans_hash(sums(self.canon, "byte"), self.starts, self.ends, "byte")
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))  # of each document

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, first: int, last: int) -> bytes:
        """Words first to last, joined by single blanks."""
        return self.canon[self.starts[first] : self.ends[last]].tobytes()


class Bytes:
    """The bytes of some texts and the document of each."""

    def __init__(self, texts: list[bytes]):
        self.canon = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        self.doc = np.repeat(np.arange(len(texts)), lengths)
        self.first = np.concatenate(([0], np.cumsum(lengths)))
        self.hashes = self.canon

    def __len__(self) -> int:
        return len(self.canon)

    def text(self, first: int, last: int) -> bytes:
        return self.canon[first : last + 1].tobytes()
