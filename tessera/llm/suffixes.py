"""Suffixes that are sampled by their content, and the ones that follow from them.

Induced sorting orders a few suffixes and derives the order of all others from
them.  Here the few are those that start at the least of 61 neighbouring 40-byte
prefixes, in the order of a hash: every string of 100 bytes holds exactly one
such place, its anchor, and equal strings hold it at the same offset.  The
suffixes at anchors are sorted with their common prefixes; a suffix that starts
one byte earlier follows from the byte put in front and the order behind it, and
its common prefix with the one before is one more than the least between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of a string that counts as repeated, and of the prefix that anchors go by.
LENGTH, PREFIX = 100, 40
#: Windows that can share an anchor.
WINDOWS = LENGTH - PREFIX + 1
#: Bytes that are hashed at a time.
PIECE = 1 << 18
#: The odd base of the hash, a mixer, and bits of a place: start, windows, offset of the anchor.
BASE, MIXER = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
RUN_BITS, OFF_BITS = 20, 8
RUN_MOST, COVERED = (1 << RUN_BITS) - 1, (1 << OFF_BITS) - 1
_POWERS: list[np.ndarray] = []


def packed(lo: np.ndarray, n: np.ndarray, off: np.ndarray | int) -> np.ndarray:
    """``n`` windows from byte ``lo``, with their anchor, or COVERED, as one long."""
    return (lo.astype(np.int64) << (RUN_BITS + OFF_BITS)) | (n.astype(np.int64) << OFF_BITS) | off


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> (RUN_BITS + OFF_BITS), (at >> OFF_BITS) & RUN_MOST, at & COVERED


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            out, k = np.ones(PIECE + 1, np.uint64), 1
            while k < len(out):
                more = min(k, len(out) - k)
                out[k : k + more] = out[:more] * np.uint64(pow(base, k, 1 << 64))
                k += more
            _POWERS.append(out)
        _POWERS.append(np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64))
    return _POWERS


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIXER
    return h ^ (h >> np.uint64(29))


def pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, start, bytes) in lots of PIECE bytes; a longer text comes in parts that share LENGTH - 1 bytes."""
    lot: list[tuple[int, int, bytes]] = []
    room = PIECE
    for i, text in enumerate(texts):
        for start in range(0, max(1, len(text) - LENGTH + 1), PIECE - LENGTH + 1):
            part = text[start : start + PIECE]
            if len(part) > room:
                yield lot
                lot, room = [], PIECE
            lot.append((i, start, part))
            room -= len(part)
    if lot:
        yield lot


def samples(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, key, ctx, at) of every anchor: the hash of its prefix, and that of all bytes of its windows."""
    power, inverse, table = _powers()
    out: list[tuple[np.ndarray, ...]] = []
    for lot in pieces(texts):
        buf = np.frombuffer(b"".join(p for _, _, p in lot), np.uint8)
        n = len(buf)
        if n < LENGTH:
            continue
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[buf] * power[:n], out=sums[1:])
        keys = _mixed((sums[PREFIX:] - sums[:-PREFIX]) * inverse[: n - PREFIX + 1])
        low = np.uint64(PIECE - 1)
        least, span = (keys & ~low) | np.arange(len(keys), dtype=np.uint64), 1
        while span < WINDOWS:
            step = min(span, WINDOWS - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        lens = np.array([len(p) for _, _, p in lot])
        ends = np.cumsum(lens)
        at = np.arange(len(least))
        at = at[at + LENGTH <= np.repeat(ends, lens)[: len(least)]]
        if not len(at):
            continue
        anchor = (least[at] & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
        lo, hi, anchor = at[first], at[np.concatenate([first[1:] - 1, [len(at) - 1]])], anchor[first]
        count, off = hi - lo + 1, anchor - lo
        shape = (count * 256 + off).astype(np.uint64) * np.uint64(BASE)
        ctx = _mixed((sums[hi + LENGTH] - sums[lo]) * inverse[lo]) ^ shape
        of = np.searchsorted(ends, lo, "right")
        text, start = (np.array([x[i] for x in lot]) for i in (0, 1))
        out.append((text[of], keys[anchor].view(np.int64), ctx.view(np.int64), packed(lo - (ends - lens)[of] + start[of], count, off)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out))


def windows(text: bytes, lo: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each of ``n`` strings of LENGTH bytes from ``lo``."""
    power, inverse, table = _powers()
    buf = np.frombuffer(text[lo : lo + n - 1 + LENGTH], np.uint8)
    found = []
    for values in (table, table[::-1]):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[buf] * power[: len(buf)], dtype=np.uint64)])
        found.append(_mixed((sums[LENGTH:] - sums[:-LENGTH]) * inverse[:n]).view(np.int64))
    return found[0], found[1]


def merged(lo: np.ndarray, n: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of a document that follow on one another, as (index of one of them, lo, n)."""
    order = np.lexsort((lo, doc))
    lo, n, doc = lo[order], n[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1] + n[:-1])])) if len(lo) else np.zeros(0, np.int64)
    return order[first], lo[first], np.add.reduceat(n, first) if len(first) else n


def _common(right: np.ndarray, lens: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before; 0 where another group starts."""
    out = np.zeros(len(right), np.int64)
    differ = right[1:] != right[:-1]
    out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), right.shape[1])
    out[1:] = np.minimum(out[1:], np.minimum(lens[1:], lens[:-1]))
    out[1:][group[1:] != group[:-1]] = 0
    return out


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(values[a:b]) of each range, none empty."""
    rows = [values]
    widest = int((b - a).max()) if len(a) else 1
    while 2 << (len(rows) - 1) <= widest:
        k = 1 << (len(rows) - 1)
        rows.append(np.concatenate([np.minimum(rows[-1][:-k], rows[-1][k:]), rows[-1][-k:]]))
    level = np.frexp((b - a).astype(np.float64))[1] - 1
    out = np.empty(len(a), values.dtype)
    for j in range(len(rows)):
        here = level == j
        out[here] = np.minimum(rows[j][a[here]], rows[j][b[here] - (1 << j)])
    return out


def induced(group: np.ndarray, rank: np.ndarray, at: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """(row, window start) of the windows that a smaller ``rank`` of their group has, too.

    Rows come in the order of group and ``right``, which is the text from the
    anchor to the end of the last window; ``left`` is the text before it, from
    the start of the first window.
    """
    lo, n, off = unpacked(at)
    m = len(at)
    lens = np.array([len(r) for r in right])
    ahead = np.frombuffer(b"".join(r.ljust(LENGTH, b"\0") for r in right), np.uint8).reshape(m, -1)
    before = np.frombuffer(b"".join(x[::-1].ljust(WINDOWS, b"\0") for x in left), np.uint8).reshape(m, -1)
    order, common = np.arange(m), _common(ahead, lens, group)
    rows, starts = [], []
    for step in range(WINDOWS):  # suffixes that start ``step`` bytes before their anchor
        if not len(order):
            break
        heads = np.flatnonzero(common < LENGTH)
        size = np.diff(np.append(heads, len(order)))
        if (size > 1).any():
            again = rank[order] > np.repeat(np.minimum.reduceat(rank[order], heads), size)
            found = order[again]
            found = found[step >= off[found] - n[found] + 1]
            rows.append(found)
            starts.append(lo[found] + off[found] - step)
        stay = np.flatnonzero(off[order] > step)
        letter = group[order[stay]] * 256 + before[order[stay], step]
        by = np.argsort(letter, kind="stable")
        old, letter = stay[by], letter[by]
        same = np.flatnonzero(letter[1:] == letter[:-1]) + 1
        following = np.zeros(len(old), np.int64)
        if len(same):
            following[same] = 1 + _least(common, old[same - 1] + 1, old[same] + 1)
        order, common = order[old], following
    return np.stack([np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, starts)])
