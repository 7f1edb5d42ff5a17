"""Shards of token ids under a Re-Pair grammar.

A shard holds the ids of consecutive documents.  Frequent pairs of neighbours
within a document become nonterminals, round by round, until none is left; rules
and the lengths of their expansions are stored, so that one document can be
decoded, or a place in it found, without the rest of the shard.

Layout, all little-endian: the magic ``RPG2``; long counts of documents, rules
and symbols, the first nonterminal and the bytes of a symbol, 2 where all are
below 2**16 and else 4; rules as pairs of symbols; expansion lengths as uint32;
document ends in symbols as int64; document lengths in ids as int64; symbols.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"RPG2"


def compress(ids: np.ndarray, doc_lens: np.ndarray, first: int, rules_per_round: int = 1 << 14, least: int = 8) -> bytes:
    """The shard of ``ids``, laid end to end by document, as bytes.

    Pairs are replaced until none occurs ``least`` times.  Each round counts all
    pairs by slot, counts those of slots that reach a quarter of the fullest one
    by one, and takes up to ``rules_per_round`` that reach it too, the most
    frequent first and the smaller ids first on equal counts.  Pairs of a round
    share no symbol as the right of one and the left of another, so that every
    occurrence is replaced; in a run of one symbol, from left to right.
    ``first`` is the id of the first nonterminal, above all ids.
    """
    seq = ids.astype(np.uint32)
    rules: list[tuple[int, int]] = []
    bits = int(np.clip(int(len(seq)).bit_length(), 10, 20))
    ceiling = len(seq)
    # the last symbol of a document has a slot that is not looked at
    nowhere = 1 << bits
    slot = np.full(len(seq), nowhere)
    slot[:-1] = _slots(seq[:-1], seq[1:], bits)
    slot[np.cumsum(doc_lens) - 1] = nowhere
    counts = np.bincount(slot, minlength=nowhere + 1)
    while len(seq) > 1:
        counts[nowhere] = 0
        # a slot counts all pairs that share it, so no pair has more than its slot
        floor = max(least, min(int(counts.max()), ceiling) // 4)
        often = np.flatnonzero((counts >= floor)[slot])
        key = seq[often].astype(np.uint64) << np.uint64(32) | seq[often + 1]
        pairs, which, n = np.unique(key, return_inverse=True, return_counts=True)
        found = np.flatnonzero(n >= floor)
        if not len(found):
            if floor == least:
                break
            # full slots held many rare pairs only; no pair reaches the floor
            ceiling = floor
            continue
        chosen = _apart(pairs, found[np.lexsort((pairs[found], -n[found]))], rules_per_round)
        symbol = np.zeros(len(pairs), np.uint32)
        symbol[chosen] = first + len(rules) + np.arange(len(chosen))
        rules += [(int(p >> np.uint64(32)), int(p & np.uint64(0xFFFFFFFF))) for p in pairs[chosen]]
        to = symbol[which]
        at, to = often[to > 0], to[to > 0]
        # hits overlap in a run of one symbol only; every second is replaced
        fresh = np.concatenate([[True], np.diff(at) > 1])
        run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - run_start) % 2 == 0
        at, to = at[take], to[take]
        # pairs that a replacement ends or makes are counted anew, all others stay
        now = at - np.arange(len(at))
        alone = now > 0
        alone[1:] &= np.diff(now) > 1
        np.subtract.at(counts, np.concatenate([slot[at], slot[at + 1], slot[at[alone] - 1]]), 1)
        seq[at] = to
        slot[at] = slot[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        keep = np.flatnonzero(keep)
        seq, slot = np.take(seq, keep), np.take(slot, keep)
        near = np.concatenate([now, now[alone] - 1])
        inner = near[slot[near] != nowhere]
        slot[inner] = _slots(seq[inner], seq[inner + 1], bits)
        np.add.at(counts, slot[near], 1)
    lengths = _lengths(rules, first)
    width = 2 if first + len(rules) <= 1 << 16 else 4
    head = struct.pack("<5q", len(doc_lens), len(rules), len(seq), first, width)
    ends = np.flatnonzero(slot == nowhere) + 1
    return b"".join([MAGIC, head, np.array(rules, f"<u{width}").tobytes(), lengths.astype("<u4").tobytes(), ends.astype("<i8").tobytes(), np.asarray(doc_lens).astype("<i8").tobytes(), seq.astype(f"<u{width}").tobytes()])


def _slots(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    return ((left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)).astype(np.int64)


def _apart(pairs: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Places of up to ``most`` pairs in ``order`` that can't overlap one another, sorted."""
    lefts, rights = set(), set()
    out = []
    for i, pair in zip(order.tolist(), pairs[order].tolist()):
        a, b = pair >> 32, pair & 0xFFFFFFFF
        if a in rights or b in lefts or a == b and (a in lefts or a in rights):
            continue
        lefts.add(a)
        rights.add(b)
        out.append(i)
        if len(out) == most:
            break
    return np.sort(np.array(out))


def _lengths(rules, first: int) -> np.ndarray:
    out: list[int] = []
    for a, b in rules:
        out.append((out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1))
    return np.array(out, np.int64)


class Shard:
    """Reads the bytes of ``compress``."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard")
        docs, rules, symbols, self.first, width = struct.unpack_from("<5q", data, 4)
        at = 44

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take(f"<u{width}", 2 * rules).astype(np.uint32).reshape(-1, 2)
        self.rule_lengths = take("<u4", rules)
        self.ends, self.doc_lens = take("<i8", docs), take("<i8", docs)
        self.symbols = take(f"<u{width}", symbols).astype(np.uint32)
        self._parts: list[np.ndarray] = []
        for a, b in self.rules.tolist():
            self._parts.append(np.concatenate([self._part(a), self._part(b)]))
        self._flat = np.concatenate(self._parts) if rules else np.zeros(0, np.uint32)
        self._off = np.concatenate([[0], np.cumsum(self.rule_lengths)])[:-1].astype(np.int64)

    def _part(self, symbol: int) -> np.ndarray:
        return self._parts[symbol - self.first] if symbol >= self.first else np.array([symbol], np.uint32)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for."""
        rule = symbols.astype(np.int64) - self.first
        long = np.flatnonzero(rule >= 0)
        lens = np.ones(len(symbols), np.int64)
        lens[long] = self.rule_lengths[rule[long]]
        ends = np.cumsum(lens)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        short = rule < 0
        out[(ends - 1)[short]] = symbols[short]
        n = lens[long]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat((ends - lens)[long], n) + step] = self._flat[np.repeat(self._off[rule[long]], n) + step]
        return out

    def document(self, i: int) -> np.ndarray:
        """The ids of one document, decoded alone."""
        return self.expand(self.symbols[(self.ends[i - 1] if i else 0) : self.ends[i]])

    def token(self, i: int, at: int) -> int:
        """One id of a document, found through the stored lengths."""
        for s in self.symbols[(self.ends[i - 1] if i else 0) : self.ends[i]].tolist():
            n = int(self.rule_lengths[s - self.first]) if s >= self.first else 1
            if at < n:
                while s >= self.first:
                    left, right = self.rules[s - self.first].tolist()
                    k = int(self.rule_lengths[left - self.first]) if left >= self.first else 1
                    s, at = (left, at) if at < k else (right, at - k)
                return s
            at -= n
        raise IndexError(at)

    def all(self) -> np.ndarray:
        """The ids of all documents, laid end to end."""
        return self.expand(self.symbols)
