"""Token ids of whole texts with the tokenizers library, a memo in front of it.

A byte-pair tokenizer first cuts a text into pre-tokens and then merges each by itself. Here a text is
cut only at places that are pre-token bounds for sure, and each distinct chunk between cuts goes
through the tokenizer once in a worker's memo. The places, for both patterns in use:

* before a single space or line feed that is followed by ASCII that is no white space, or by the lead
  byte of Latin-1 letters (a run of white space gives up its last character there), and after such a
  line feed;
* before ASCII that is neither letter nor white space, after an ASCII or Latin-1 letter.

No look-ahead of the patterns crosses them, so the ids are those of the whole text; anything else, such
as double spaces or other scripts, only makes a chunk longer.

The memo finds a chunk by a hash and then compares its bytes, so no two chunks can be taken for one another;
chunks of more than ``Encoder.WIDEST`` bytes are not kept.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np

from lattice.llm.text import LOWER, U64, lane, lanes_of, span_hashes

_b = np.arange(256)
_SPACE = (_b == 32) | ((_b >= 9) & (_b <= 13)) | ((_b >= 28) & (_b <= 31))
_ALPHA = ((_b >= 65) & (_b <= 90)) | ((_b >= 97) & (_b <= 122))
_FOLLOW = ((_b < 128) & ~_SPACE) | (_b == 0xC3)
_MARK = (_b < 128) & ~_SPACE & ~_ALPHA


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file. spaces: white space makes no tokens, so it is a chunk apart; lower: ASCII case makes no difference."""

    path: str
    end_id: int
    spaces: bool = False
    lower: bool = False


class Encoder:
    """Ids of blocks of texts. The memo holds at most about ``keep`` chunks; it starts anew beyond that."""

    SLOTS = 1 << 19
    WIDEST = 64

    def __init__(self, vocabulary: Vocabulary, keep: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.vocabulary, self.keep = vocabulary, keep
        self.tokenizer = Tokenizer.from_file(vocabulary.path)
        self.tokenizer.encode_special_tokens = True
        self.clear()

    def clear(self) -> None:
        self.slot_hash, self.slot_at = np.zeros(self.SLOTS, U64), np.zeros(self.SLOTS, np.int32)
        self.known, self.known_at = np.zeros(0, U64), np.zeros(0, np.int32)
        self.recent: dict[int, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 1
        self.begin, self.size, self.n = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32), 1
        self.bytes, self.lane_at = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.lanes, self.lanes_used = np.zeros(1 << 16, U64), 1
        self.ids[0], self.begin[0], self.size[0] = self.vocabulary.end_id, 0, 1  # chunk 0 is the end of a text

    def cuts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(buf) + 2, bool)
        follow = np.zeros(len(buf), bool)
        follow[:-1] = _FOLLOW[buf[1:]]
        line = (buf == 10) & follow
        cut[: len(buf)] = line | ((buf == 32) & follow)
        cut[1 : len(buf) + 1] |= line
        if self.vocabulary.spaces:
            cut[1 : len(buf) + 1] |= (buf == 32) & follow
        letter = _ALPHA[buf]
        letter[1:] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
        cut[1 : len(buf)] |= _MARK[buf[1:]] & letter[:-1]
        cut[offsets] = True
        return np.flatnonzero(cut[: len(buf)])

    def __call__(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with the end id, as unsigned 32-bit integers; where each text's begin (one more)."""
        if self.vocabulary.lower:
            buf = LOWER[buf]
        if len(buf):
            starts = self.cuts(buf, offsets)
            ends = np.append(starts[1:], len(buf))
            chunk = self.look_up(buf, starts, ends)
        else:
            starts, chunk = np.zeros(0, np.int64), np.zeros(0, np.int32)
        first = np.searchsorted(starts, offsets)
        texts = len(offsets) - 1
        order = np.insert(chunk, first[1:], np.zeros(texts, np.int32))
        size = self.size[order].astype(np.int64)
        at = np.concatenate(([0], np.cumsum(size)))
        take = np.arange(at[-1]) + np.repeat(self.begin[order] - at[:-1], size)
        return self.ids[take], at[np.concatenate(([0], first[1:] + np.arange(1, texts + 1)))]

    def look_up(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The memo's number of each chunk."""
        if self.n > self.keep or self.used > 8 * self.keep:
            self.clear()
        lanes, size, data = lanes_of(buf), ends - starts, buf.tobytes()
        out = np.zeros(len(starts), np.int32)
        wide = np.flatnonzero(size > self.WIDEST)
        out[wide] = self.add(data, starts[wide], ends[wide])
        at = np.flatnonzero(size <= self.WIDEST)
        found = self.remembered(data, lanes, starts[at], ends[at])
        unlike = np.flatnonzero(~self.same(lanes, starts[at], size[at], found))
        found[unlike] = self.add(data, starts[at[unlike]], ends[at[unlike]])
        out[at] = found
        return out

    def same(self, lanes: np.ndarray, starts: np.ndarray, size: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        """Whether the chunks kept under the numbers have these bytes."""
        out = self.bytes[chunk] == size
        at, k = np.flatnonzero(out), 0
        while len(at):
            out[at] = lane(lanes, starts[at], size[at], k) == self.lanes[self.lane_at[chunk[at]] + k]
            k += 1
            at = at[(size[at] > 8 * k) & out[at]]
        return out

    def remembered(self, data: bytes, lanes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers by hash, new chunks added."""
        h = span_hashes(np.frombuffer(data, np.uint8), starts, ends)
        slot = (h >> U64(64 - 19)).astype(np.int64)
        out = self.slot_at[slot]
        miss = np.flatnonzero(self.slot_hash[slot] != h)
        if len(miss):
            new, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            at = np.full(len(new), -1, np.int32)
            if len(self.known):
                k = np.minimum(np.searchsorted(self.known, new), len(self.known) - 1)
                at = np.where(self.known[k] == new, self.known_at[k], at)
            for j in np.flatnonzero(at < 0).tolist() if self.recent else ():
                at[j] = self.recent.get(int(new[j]), -1)
            lack = np.flatnonzero(at < 0)
            if len(lack):
                rows = miss[where[lack]]
                at[lack] = self.add(data, starts[rows], ends[rows])
                self.keep_bytes(lanes, starts[rows], ends[rows] - starts[rows], at[lack])
                self.recent.update(zip(new[lack].tolist(), at[lack].tolist(), strict=True))
                if len(self.recent) > 50_000:
                    more = np.fromiter(self.recent.keys(), U64, len(self.recent))
                    more_at = np.fromiter(self.recent.values(), np.int32, len(self.recent))
                    both, both_at = np.concatenate((self.known, more)), np.concatenate((self.known_at, more_at))
                    order = np.argsort(both)
                    self.known, self.known_at, self.recent = both[order], both_at[order], {}
            slot = (new >> U64(64 - 19)).astype(np.int64)
            self.slot_hash[slot], self.slot_at[slot] = new, at
            out[miss] = at[back]
        return out

    def keep_bytes(self, lanes: np.ndarray, starts: np.ndarray, size: np.ndarray, chunk: np.ndarray) -> None:
        count = (size + 7) // 8
        total = int(count.sum())
        while self.lanes_used + total > len(self.lanes):
            self.lanes = np.concatenate((self.lanes, np.zeros(len(self.lanes), U64)))
        begin = self.lanes_used + np.cumsum(count) - count
        self.bytes[chunk], self.lane_at[chunk] = size, begin
        for k in range(int(count.max(initial=0))):
            at = np.flatnonzero(count > k)
            self.lanes[begin[at] + k] = lane(lanes, starts[at], size[at], k)
        self.lanes_used += total

    def add(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encodes chunks; the numbers that their ids are kept under."""
        if not len(starts):
            return np.zeros(0, np.int32)
        chunks = [data[s:e].decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
        while self.n + len(ids) > len(self.begin):
            self.begin, self.size, self.bytes, self.lane_at = (np.concatenate((x, np.zeros(len(x), np.int32))) for x in (self.begin, self.size, self.bytes, self.lane_at))
        own = slice(self.n, self.n + len(ids))
        self.ids[self.used : self.used + len(flat)] = flat
        self.size[own] = size
        self.begin[own] = self.used + np.cumsum(size) - size
        self.n, self.used = self.n + len(ids), self.used + len(flat)
        return np.arange(own.start, own.stop, dtype=np.int32)


_encoders: dict[Vocabulary, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """This worker's encoder, whose memo lasts from task to task."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]
