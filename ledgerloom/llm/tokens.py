"""Token ids by a byte-level BPE of the tokenizers library, with encoded pieces remembered.

Texts are cut where the library's pattern always starts a new match, so the ids of a text are the
ids of its pieces end to end. Pieces are found, looked up and put together by numpy over a whole
batch of texts; the library encodes only those that a Python worker has not seen yet.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Slots of a worker's memory of pieces (20 bytes each, at most half in use) and bytes encoded together.
SLOTS, TOGETHER = 1 << 21, 2 << 20
#: Longest piece that is remembered, in bytes; longer ones are encoded each time.
LONGEST = 15

_LETTER, _DIGIT, _SIGN, _WHITE, _WIDE, _OTHER = range(6)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = _WHITE
_CLASS[128:] = _WIDE
_CLASS[28:32] = _OTHER
#: Masks of the first bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def cuts(d: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places in the UTF-8 bytes d, past 0, before which the pattern always starts a new match; texts start at bounds.

    A blank or line end starts one if what precedes it is no white space, or if what follows is
    none; so does what follows a line end and is no white space, and a sign after a letter or digit.
    Where a byte beyond ASCII might be white space or no letter, there is no cut.
    """
    kind = _CLASS[d]
    before, here = kind[:-1], kind[1:]
    wide = before == _WIDE
    # bytes beyond ASCII that can end a white space character: U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000
    ends = np.flatnonzero(wide)
    two, three = d[ends - 1], d[ends - 2]  # the first bytes of d are never such an end, so wrapping round is harmless
    doubtful = (two == 0xC2) | (three == 0xE1) & (two == 0x9A) | (three == 0xE2) & (two <= 0x81) | (three == 0xE3) & (two == 0x80)
    letter = (two == 0xC3) & (d[ends] != 0x97) & (d[ends] != 0xB7)
    solid, word = before <= _SIGN, before <= _DIGIT
    solid[ends] = ~doubtful
    word[ends] = letter
    after = np.append(kind[2:] <= _SIGN, False)
    after[bounds[(bounds > 1) & (bounds < len(d))] - 2] = False  # what follows a text's last byte is another text's
    gap = (d[1:] == 32) | (d[1:] == 10)
    start = gap & (solid | after) | (d[:-1] == 10) & (here <= _SIGN) | (here == _SIGN) & word
    return np.flatnonzero(start) + 1


class Memory:
    """Ids of pieces by their bytes: an open-addressing table of up to 15 bytes and a length, compared in full.

    Once half full, or too large by its ids, it keeps the pieces that were asked for again, or
    nothing if those are too many. So it is bounded by bytes, whatever the texts.
    """

    def __init__(self, slots: int = SLOTS):
        self.slots, self.shift = slots, np.uint64(64 - (slots.bit_length() - 1))
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros((2, self.slots), np.uint64)
        self.number = np.zeros(self.slots, np.int32)  # 1 + number of the piece; 0 if free
        self.start, self.length = np.zeros((2, self.slots // 2), np.int32)
        self.again = np.zeros(self.slots // 2, bool)
        self.ids, self.size, self.held = np.zeros(1 << 16, np.uint32), 0, 0

    def _probe(self, keys: np.ndarray):
        """For each round of probing: the keys still open and their slots; is sent which stay open."""
        slot = ((keys[0] ^ (keys[1] * _MIX)) * _MIX2 >> self.shift).astype(np.int64)
        open_ = np.arange(keys.shape[1])
        while len(open_):
            left = yield open_, slot
            slot, open_ = (slot[left] + 1) & (self.slots - 1), open_[left]

    def _rounds(self, keys: np.ndarray, step) -> None:
        probe = self._probe(keys)
        try:
            at = next(probe)
            while True:
                at = probe.send(step(*at))
        except StopIteration:
            pass

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 if unknown."""
        out = np.full(keys.shape[1], -1, np.int64)

        def step(open_, slot):
            number = self.number[slot]
            same = (number > 0) & (self.keys[0][slot] == keys[0][open_]) & (self.keys[1][slot] == keys[1][open_])
            out[open_[same]] = number[same] - 1
            return (number > 0) & ~same

        self._rounds(keys, step)
        return out

    def put(self, ids: np.ndarray) -> int:
        """Place of ids in the memory's own array."""
        if self.held + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.held], np.zeros(max(len(ids), self.held), np.uint32)])
        self.ids[self.held : self.held + len(ids)] = ids
        self.held += len(ids)
        return self.held - len(ids)

    def add(self, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Learn distinct unknown pieces with the places of their ids; their numbers."""
        first, n = self.size, len(lengths)
        self.start[first : first + n], self.length[first : first + n], self.again[first : first + n] = starts, lengths, False
        self.size += n

        def step(open_, slot):
            free = self.number[slot] == 0
            self.number[slot[free]] = first + 1 + open_[free]  # of several for one slot the last stays
            won = free & (self.number[slot] == first + 1 + open_)
            for k in range(2):
                self.keys[k][slot[won]] = keys[k][open_[won]]
            return ~won

        self._rounds(keys, step)
        return np.arange(first, first + n)

    def room(self, pieces: int, ids: int) -> None:
        """Make room for so many more pieces and ids; numbers and places given before may be void then."""
        if self.size + pieces <= self.slots // 2 and self.held + ids <= 4 * self.slots:
            return
        used = np.flatnonzero(self.number)
        used = used[self.again[self.number[used] - 1]]
        number = self.number[used] - 1
        keys, lengths = self.keys[:, used], self.length[number].astype(np.int64)
        kept = self.ids[ranges(self.start[number].astype(np.int64), lengths)]
        self.forget()
        if len(number) + pieces <= self.slots * 3 // 8 and len(kept) + ids <= 3 * self.slots:
            base = self.put(kept)
            self.add(keys, base + np.cumsum(lengths) - lengths, lengths)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each length, end to end."""
    ends = np.cumsum(lengths)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    some = np.flatnonzero(lengths)
    if len(some):
        s, n = starts[some], lengths[some]
        out[0] = s[0]
        out[ends[some][:-1]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


class Encoder:
    """Encodes texts to unsigned 32-bit ids. Texts with an added token's string go to the library whole."""

    def __init__(self, path: str, special_as_text: bool = False, slots: int = SLOTS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if special_as_text:
            self.tokenizer.encode_special_tokens = True
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.starts = np.zeros(self.vocabulary, bool)
        self.starts[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("Ġ")]] = True
        self.line_end = self._whole("\n")
        self.memory = Memory(slots)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, text: str) -> np.ndarray:
        return self._ids([text])[0]

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces end to end, and their numbers.

        Pieces with no white space but a blank at their start are encoded end to end, since only a
        piece's first token starts with a blank; those without any with line ends between them.
        """
        blank, bare, rest = [], [], []
        texts = [p.decode() for p in pieces]
        for k, t in enumerate(texts):
            body = t[1:] if t[0] == " " else t
            (rest if body.split() != [body] else blank if len(body) < len(t) else bare).append(k)
        order, found, counts = [*blank, *bare, *rest], [], []

        def singly(part: list[str]) -> None:
            ids = self._ids(part)
            found.extend(ids)
            counts.append(np.array([len(x) for x in ids], np.int64))

        for group, between in ((blank, ""), (bare, "\n")):
            for at in range(0, len(group), 500):
                part = [texts[k] for k in group[at : at + 500]]
                ids = self._whole(between.join(part))
                first = ids == self.line_end[0] if between else self.starts[ids]
                starts = np.flatnonzero(first)
                if len(starts) != len(part) - len(between):
                    singly(part)
                elif between:
                    counts.append(np.diff(np.concatenate([[-1], starts, [len(ids)]])) - 1)
                    found.append(ids[~first])
                else:
                    counts.append(np.diff(np.append(starts, len(ids))))
                    found.append(ids)
        if rest:
            singly([texts[k] for k in rest])
        n, ids = np.concatenate(counts), np.concatenate(found)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return ids[ranges((np.cumsum(n) - n)[back], n[back])], n[back]

    def _some(self, d: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that end at bounds[1:] in d, and where each text's ids begin."""
        if not len(d):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        memory = self.memory
        mark = np.zeros(len(d), bool)
        mark[cuts(d, bounds)] = True
        mark[bounds[bounds < len(d)]] = True
        at = np.flatnonzero(mark)
        length = np.diff(np.append(at, len(d)))
        padded = np.append(d, np.zeros(16 + -len(d) % 8, np.uint8))
        word = np.lib.stride_tricks.as_strided(padded.view("<u8"), (len(d) + 9,), (1,))
        keys = np.empty((2, len(at)), np.uint64)
        keys[0] = word[at] & _FIRST[np.minimum(length, 8)]
        keys[1] = word[np.minimum(at + 8, len(d))] & _FIRST[np.clip(length - 8, 0, 7)] | np.minimum(length, 255).astype(np.uint64) << np.uint64(56)
        number = memory.find(keys)
        number[length > LONGEST] = -1
        new = np.flatnonzero(number < 0)
        starts, counts = memory.start[number].astype(np.int64), memory.length[number].astype(np.int64)
        memory.again[number[number >= 0]] = True
        if len(new):
            data, where = d.tobytes(), {}
            of = np.array([where.setdefault(data[a : a + n], len(where)) for a, n in zip(at[new].tolist(), length[new].tolist())], np.int64)
            pieces = list(where)
            learnt, n = self._learn(pieces)
            base = memory.put(learnt)
            begin = base + np.cumsum(n) - n
            starts[new], counts[new] = begin[of], n[of]
        ids = memory.ids[ranges(starts, counts)]
        total = np.append(0, np.cumsum(counts, dtype=np.int64))
        if len(new):
            short = np.flatnonzero(np.fromiter(map(len, pieces), np.int64, len(pieces)) <= LONGEST)
            first = np.empty(len(pieces), np.int64)
            first[of[::-1]] = new[::-1]
            held, often = keys[:, first[short]], np.bincount(of, minlength=len(pieces))[short] > 1
            memory.held = base
            memory.room(len(short), len(learnt))
            begin = memory.put(learnt) + np.cumsum(n) - n
            if len(short) <= memory.slots // 2:
                memory.again[memory.add(held, begin[short], n[short])] = often
        return ids, total[np.searchsorted(at, bounds)]

    def encode_array(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of texts: how many there are, their ids end to end, and where each text's begin and the last one's end.

        A null or empty text has none. A run has about TOGETHER bytes, or one text; of a longer text
        not more than that is worked on at once.
        """
        texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        d = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + TOGETHER, "right")) - 1)
            part, bounds = d[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            raw = part.tobytes() if self.added else b""
            if any(a in raw for a in self.added):
                ids = self._ids([raw[x:y].decode() for x, y in zip(bounds.tolist(), bounds[1:].tolist())])
                yield to - at, np.concatenate(ids), np.append(0, np.cumsum([len(x) for x in ids]))
            elif len(part) <= 2 * TOGETHER:
                yield to - at, *self._some(part, bounds)
            else:  # one long text
                ids = [self._some(x, np.array([0, len(x)]))[0] for x in _slices(part)]
                yield 1, np.concatenate(ids), np.array([0, sum(map(len, ids))])
            at = to

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, little-endian; a null or empty text has none."""
        return list(self.encode_column(pa.array(texts, pa.large_string())))

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """The little-endian ids of each text, in order."""
        for _, ids, begin in self.encode_array(texts):
            data = ids.astype("<u4").tobytes()
            for a, b in zip(begin.tolist(), begin[1:].tolist()):
                yield data[4 * a : 4 * b]


def _slices(d: np.ndarray) -> Iterator[np.ndarray]:
    """A long text's bytes in parts of about TOGETHER bytes, cut where the pattern starts a match."""
    at = 0
    while len(d) - at > 2 * TOGETHER:
        size = TOGETHER
        while True:
            near = d[at + size - 4 : at + 2 * size + 2]
            some = cuts(near, np.zeros(0, np.int64))
            some = some[(some > 4) & (some <= size) & (_CLASS[near[some]] == _WHITE)]
            if len(some) or at + 2 * size + 2 >= len(d):
                break
            size *= 2
        if not len(some):
            break
        to = at + size - 4 + int(some[0])
        yield d[at:to]
        at = to
    yield d[at:]


@functools.lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(path, special_as_text)
