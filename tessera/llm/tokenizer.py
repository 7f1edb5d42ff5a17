"""Whole-text encoding with a public tokenizer file, one lookup per word.

The vocabulary file splits text at white space before anything else, so the ids
of a text are the ids of its space-separated words laid end to end.  A bounded
table from word to ids therefore replaces the encoder for every word seen
before.  New words of small Latin letters are merged by the file's own rules,
all at once; other new words go through the ``tokenizers`` library.  Texts stay
in the buffer that Arrow brings them in; no string is made of a known word.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.arrow import claim

#: Id written after the last id of every document.
END_ID = 2
#: How the files that this module takes normalise and split text.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTERS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: Marks that make a piece of their own after a letter or digit.
MARKS = b"!\"#$%&()*+,-./:;=?@[]^_`{|}~"
#: Bytes of a word that its key holds, and marks that are cut from its end.
SHORT, TAIL = 15, 8
WAYS = 4
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)
_ENCODERS: dict[tuple[str, int], "WordEncoder"] = {}


def _table(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(bytes(values), np.uint8)] = True
    return out


SPACE, MARK = _table(b" \t\n\r\x0b\x0c"), _table(MARKS)
LETTER, DIGIT = _table(range(97, 123)), _table(range(48, 58))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Small letters below U+0250 that normalising leaves as they are, by the code of their two bytes.
PAIRED = np.zeros(1 << 16, bool)
PAIRED[[int.from_bytes(chr(i).encode()) for i in range(0xC0, 0x250) if chr(i).isalpha() and chr(i).lower() == chr(i) == unicodedata.normalize("NFC", chr(i))]] = True
#: The first so many bytes of eight, and the length above the second eight.
KEEP = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1] * 8, np.uint64)


def _spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places of runs of ``lens`` from ``starts``, end to end."""
    ends = np.cumsum(lens)
    return np.repeat(starts - ends + lens, lens) + np.arange(int(ends[-1]) if len(ends) else 0)


class Merges:
    """The file's merges, applied to many words at once.

    Each step joins in every word the pair of the lowest rank, the leftmost of
    equal ones, which is the order of byte pair encoding.
    """

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [tuple(m) if isinstance(m, (list, tuple)) else tuple(m.split(" ")) for m in merges]
        if len(vocab) >= 1 << 20 or len(pairs) >= 1 << 20:
            raise ValueError("the vocabulary is too large for packed pairs")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.none = 1 << 20
        self.inner = np.array([vocab.get(names[b], self.none - 1) for b in range(256)], np.int64)
        self.last = np.array([vocab.get(names[b] + "</w>", self.none - 1) for b in range(256)], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.uint64)
        rank = np.arange(len(pairs), dtype=np.uint64)
        # pairs that share a place of one table go to the next, smaller one
        self.levels, bits = [], 19
        while len(key):
            slot = self._slot(key, len(self.levels), bits)
            _, first = np.unique(slot, return_index=True)
            held = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
            held[slot[first]] = key[first] << np.uint64(24) | rank[first]
            self.levels.append((bits, held))
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, rank, bits = key[rest], rank[rest], max(8, bits - 4)

    @staticmethod
    def _slot(key: np.ndarray, level: int, bits: int) -> np.ndarray:
        return ((key * (ODD[level % 3] + np.uint64(2 * level))) >> np.uint64(64 - bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; those that don't merge have ``none``."""
        key = a.astype(np.uint64) << np.uint64(20) | b.astype(np.uint64)
        out = np.full(len(key), self.none, np.int64)
        for level, (bits, held) in enumerate(self.levels):
            got = held[self._slot(key, level, bits)]
            hit = got >> np.uint64(24) == key
            out[hit] = (got[hit] & np.uint64(0xFFFFFF)).astype(np.int64)
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of at most ``SHORT`` bytes of ``data``, end to end, and the number of each."""
        n, width = len(starts), int(lens.max(initial=1))
        rows = np.arange(width)[:, None]
        inside = rows < lens
        raw = data[np.minimum(starts + rows, len(data) - 1)]
        # symbols by place and word, with a place that never merges at both ends
        sym = np.full((width + 2, n), self.none - 1, np.int64)
        sym[1:-1] = np.where(rows == lens - 1, self.last[raw], np.where(inside, self.inner[raw], self.none - 1))
        stop = np.int64(self.none) << 5
        order = np.full((width + 2, n), stop)
        before, after = np.nonzero(rows[:-1] < lens - 1) if width > 1 else (np.zeros(0, int),) * 2
        order[before + 1, after] = self.ranks(sym[before + 1, after], sym[before + 2, after]) << 5 | before + 1
        order[order >= stop] = stop
        place = np.arange(width + 2, dtype=np.int64)[:, None]
        following, leading = np.repeat(np.minimum(place + 1, width + 1), n, 1), np.repeat(np.maximum(place - 1, 0), n, 1)
        live = np.zeros((width + 2, n), bool)
        live[1:-1] = inside
        flat = [x.ravel() for x in (sym, order, following, leading, live)]
        sym_, order_, following_, leading_, live_ = flat
        word = np.arange(n)
        while len(word):
            best = (order if len(word) == n else order[:, word]).min(0)
            some = best < stop
            word, best = word[some], best[some]
            at = (best & 31) * n + word
            gone = following_[at] * n + word
            sym_[at] = self.made[best >> 5]
            live_[gone] = False
            order_[gone] = stop
            right, left = following_[gone], leading_[at]
            following_[at] = right
            right_at, left_at = right * n + word, left * n + word
            leading_[right_at] = best & 31
            r = self.ranks(np.concatenate([sym_[at], sym_[left_at]]), np.concatenate([sym_[right_at], sym_[at]]))
            r = np.where(r < self.none, r << 5 | np.concatenate([best & 31, left]), stop)
            order_[at], order_[left_at] = r[: len(word)], r[len(word) :]
        return sym.T[live.T].astype(np.uint32), live.sum(0)


class WordEncoder:
    """Encodes texts through a table of ``slots`` words at most, a power of two.

    A word has one of four places; where all are taken another word goes, which
    costs time and never changes a result.  ASCII capitals are looked up as small
    letters, as the vocabulary lower-cases anyway; texts with ``<|``, which may
    open a special token, keep theirs.  A null text encodes as an empty one.
    """

    def __init__(self, path: str, slots: int = 1 << 21):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>"}
        steps = (spec.get("normalizer") or {}).get("normalizers"), (spec.get("pre_tokenizer") or {}).get("pretokenizers")
        if steps != (NORMALIZERS, SPLITTERS) or any(model.get(k) != v for k, v in plain.items()):
            raise ValueError(f"{path} doesn't split or merge words as this encoder does")
        self._tok = Tokenizer.from_file(path)
        #: All ids are below this.
        self.size = max(self._tok.get_vocab(with_added_tokens=True).values()) + 1
        self._merges = Merges(model["vocab"], model["merges"])
        self._bits = max(1, (slots // WAYS).bit_length() - 1)
        self._clear()

    def _clear(self) -> None:
        size = WAYS << self._bits
        self._lo, self._hi = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self._off, self._len = np.zeros(size, np.int64), np.zeros(size, np.int32)
        # the first id of the store is that of the end of a document
        self._ids = np.zeros(1 << 16, np.uint32)
        self._ids[0], self._used = END_ID, 1

    def _add_ids(self, ids: np.ndarray) -> int:
        at = self._used
        if at + len(ids) > len(self._ids):
            more = np.zeros(max(2 * len(self._ids), at + len(ids)), np.uint32)
            more[:at] = self._ids[:at]
            self._ids = more
        self._ids[at : at + len(ids)] = ids
        self._used += len(ids)
        return at

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        enc = self._tok.encode(words, is_pretokenized=True, add_special_tokens=False)
        of = np.asarray(enc.word_ids, np.int64)
        return np.asarray(enc.ids, np.uint32), np.bincount(of, minlength=len(words)) if len(of) else np.zeros(len(words), np.int64)

    def _encode_new(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id in the store and number of ids of new words."""
        place = _spread(starts, lens)
        byte = data[place]
        code = byte.astype(np.int64) << 8
        code[:-1] |= byte[1:]
        lead = PAIRED[code]
        good = LETTER[byte] | lead
        good[1:] |= lead[:-1]
        first = np.cumsum(lens) - lens
        plain = np.logical_and.reduceat(good, first) if len(first) else np.zeros(0, bool)
        # a word doesn't end between two bytes, so a pair lies within one word
        off, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        mine = np.flatnonzero(plain & (lens <= SHORT))
        for group in np.array_split(mine[np.argsort(lens[mine], kind="stable")], max(1, -(-len(mine) // 16384))):
            if len(group):
                ids, k = self._merges.encode(data, starts[group], lens[group])
                off[group], n[group] = self._add_ids(ids) + np.cumsum(k) - k, k
        if len(rest := np.flatnonzero(~(plain & (lens <= SHORT)))):
            words = [data[a : a + k].tobytes().decode("utf-8", "surrogatepass") for a, k in zip(starts[rest].tolist(), lens[rest].tolist())]
            ids, k = self._library(words)
            off[rest], n[rest] = self._add_ids(ids) + np.cumsum(k) - k, k
        return off, n

    def _words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and lengths of the pieces to look up, and the pieces before each text.

        ``data`` becomes lower-case where its texts allow.
        """
        special = np.zeros(len(bounds) - 1, bool)
        bars = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        if len(bars):
            special[np.searchsorted(bounds, bars, side="right") - 1] = True
            raw = data.copy()
        np.take(LOWER, data, out=data, mode="clip")
        for i in np.flatnonzero(special).tolist():
            data[bounds[i] : bounds[i + 1]] = raw[bounds[i] : bounds[i + 1]]
        word = ~SPACE[data]
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        opens[inner] = word[inner]
        closes[inner - 1] = word[inner - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        # marks at the end of a word are pieces of their own after a plain letter or digit
        at, cut = np.flatnonzero(MARK[data[ends - 1]]), ends.copy()
        for _ in range(TAIL):
            cut[at] -= 1
            at = at[cut[at] > starts[at]]
            at = at[MARK[data[cut[at] - 1]]]
            if not len(at):
                break
        cut[at] = starts[at]  # a longer tail stays with its word
        cuts = np.flatnonzero((cut > starts) & (cut < ends))
        before = data[cut[cuts] - 1]
        two = np.where(cut[cuts] - starts[cuts] > 1, data[np.maximum(cut[cuts] - 2, 0)].astype(np.int64) << 8 | before, 0)
        good = LETTER[before] | DIGIT[before] | PAIRED[two]
        if len(bars):
            good &= ~special[np.searchsorted(bounds, starts[cuts], side="right") - 1]
        cuts = cut[cuts[good]]
        opens[cuts] = True
        closes[cuts - 1] = True
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        return starts, ends - starts, np.searchsorted(starts, bounds)

    def _short(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First ids and numbers of ids of words of ``SHORT`` bytes at most; ``data`` has 16 bytes more than they need."""
        eight = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
        lo = eight[starts] & KEEP[np.minimum(lens, 8)]
        hi = eight[starts + 8] & KEEP[np.maximum(lens - 8, 0)] | lens.astype(np.uint64) << np.uint64(56)
        mixed = (lo ^ hi * ODD[1]) * ODD[0]
        mixed = (mixed ^ mixed >> np.uint64(29)) * ODD[2]
        place = (mixed >> np.uint64(64 - self._bits)).astype(np.int64) * WAYS
        off, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int32)
        # words that came early, which are often the frequent ones, have the first of the places
        missing, at, a, b = np.arange(len(starts)), place, lo, hi
        for _ in range(WAYS):
            same = (self._lo[at] == a) & (self._hi[at] == b)
            hit = missing[same]
            off[hit], n[hit] = self._off[at[same]], self._len[at[same]]
            missing, at, a, b = missing[~same], at[~same] + 1, a[~same], b[~same]
        while len(missing):
            # words of one hash are told apart by their keys; those of another key come next time
            _, one, back = np.unique(mixed[missing], return_index=True, return_inverse=True)
            known = missing[one]
            alike = (lo[missing] == lo[known][back]) & (hi[missing] == hi[known][back])
            first, count = self._encode_new(data, starts[known], lens[known])
            off[missing[alike]], n[missing[alike]] = first[back[alike]], count[back[alike]]
            self._keep(place[known], mixed[known], lo[known], hi[known], first, count)
            missing = missing[~alike]
        return off, n

    def _keep(self, place, mixed, lo, hi, off, n) -> None:
        """Give new words places: a free one, else one that the hash names."""
        used = sum((self._hi[place + w] != 0).astype(np.int64) for w in range(WAYS))
        # words of one bucket take turns, from the first free place on
        order = np.argsort(place, kind="stable")
        turn = np.empty(len(order), np.int64)
        turn[order] = np.arange(len(order)) - np.searchsorted(place[order], place[order])
        way = np.where(used + turn < WAYS, used + turn, (mixed & np.uint64(WAYS - 1)).astype(np.int64))
        # of words with one place the last counts, in all four arrays
        at, last = np.unique((place + way)[::-1], return_index=True)
        last = len(place) - 1 - last
        self._lo[at], self._hi[at], self._off[at], self._len[at] = lo[last], hi[last], off[last], n[last]

    def encode(self, texts: pa.Array | list[str | None], end: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end (uint32) and the number of ids of each text.

        With ``end``, ``END_ID`` follows each text, so a text has one id at least.
        """
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "").cast(pa.large_string())
        if not len(column):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self._used > (8 * WAYS << self._bits) + (1 << 20):
            self._clear()
        bounds = np.frombuffer(column.buffers()[1], "<i8")[column.offset : column.offset + len(column) + 1].astype(np.int64)
        body = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        data = np.zeros(len(body) + 24, np.uint8)
        data[: len(body)] = body
        starts, lens, before = self._words(data[: len(body)], bounds - bounds[0])
        brief = lens <= SHORT
        if brief.all():
            off, n = self._short(data, starts, lens)
        else:
            off, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int32)
            off[brief], n[brief] = self._short(data, starts[brief], lens[brief])
            off[~brief], n[~brief] = self._long(data, starts[~brief], lens[~brief])
        if end:
            off, n = np.insert(off, before[1:], 0), np.insert(n, before[1:], 1)
            before = before + np.arange(len(before))
        flat = self._ids[_spread(off, n.astype(np.int64))]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        return flat, ends[before[1:]] - ends[before[:-1]]

    def _long(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First ids and numbers of ids of longer words, each distinct one encoded once a call."""
        first: dict[bytes, int] = {}
        which = [first.setdefault(data[a : a + k].tobytes(), len(first)) for a, k in zip(starts.tolist(), lens.tolist())]
        _, one = np.unique(which, return_index=True)
        off, n = self._encode_new(data, starts[one], lens[one])
        return off[which], n[which]

    def encode_with_end(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with the end id after each text."""
        return self.encode(texts, end=True)


def encoder(path: str, slots: int = 1 << 21) -> WordEncoder:
    """The encoder of this process for a tokenizer file."""
    claim("encoder", _ENCODERS.clear)
    if (path, slots) not in _ENCODERS:
        _ENCODERS[path, slots] = WordEncoder(path, slots)
    return _ENCODERS[path, slots]
