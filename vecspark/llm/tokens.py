"""Token ids of Arrow string batches with the tokenizers library, one call per distinct piece.

Both public vocabularies split a text by a pattern before any merge. No piece of that
pattern goes on after a blank that follows a non-blank, nor past a letter or digit into
one of ``,.;:!?``. So a text may be cut at both places, and ids(text) = ids of the cuts,
joined. Cuts repeat; each distinct one is encoded once and kept in a bounded table that is
searched by hash and compared byte by byte. Texts with blanks outside ASCII (whose runs
could be cut apart) are encoded whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 2 << 20
CACHE_ENTRIES = 1_600_000
TABLE_BYTES = 256 << 20
_SLOT_BITS = 22
_PROBES = 16
_RADIX = 0x9E3779B97F4A7C15
_INVERSE = pow(_RADIX, -1, 1 << 64)

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b",.;:!?")] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
#: ASCII capitals to small letters, ASCII blanks to spaces.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[_BLANK] = 32
#: Bytes that can begin a blank outside ASCII, or are one of the separators 28 to 31.
_RARE = np.zeros(256, bool)
_RARE[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def odd_places(data: np.ndarray) -> np.ndarray:
    """Places of blanks outside ASCII and of the separators 28 to 31."""
    at = np.flatnonzero(_RARE[data])
    b, last = data[at], len(data) - 1
    one, two = data[np.minimum(at + 1, last)], data[np.minimum(at + 2, last)]
    odd = b < 0x20
    odd |= (b == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (b == 0xE1) & (one == 0x9A) & (two == 0x80)
    odd |= (b == 0xE2) & (one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF)) | (b == 0xE2) & (one == 0x81) & (two == 0x9F)
    odd |= (b == 0xE3) & (one == 0x80) & (two == 0x80)
    return at[odd]


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted starts of the pieces of all texts; ``offsets`` are the texts' bounds in ``data``."""
    blank = _BLANK[data]
    start = blank.copy()
    start[1:] &= ~blank[:-1]
    start[1:] |= _STOP[data[1:]] & _PLAIN[data[:-1]]
    for text in np.unique(np.searchsorted(offsets, odd_places(data), "right") - 1).tolist():
        start[offsets[text] : offsets[text + 1]] = False
    start[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(start)


def folds(spec: dict) -> bool:
    """Whether a tokenizer lower-cases its text and drops blanks, so that pieces may be folded before they are looked up."""
    normal, before = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    lowers = "Lowercase" in [n["type"] for n in normal.get("normalizers", [])]
    first = (before.get("pretokenizers") or [{}])[0]
    return lowers and first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))


class Pieces:
    """Table of known pieces: bytes and ids by 64-bit hash, open addressing in numpy arrays."""

    def __init__(self):
        self.slots = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.n = self.n_bytes = self.n_ids = 0
        self.key = np.zeros(1 << 16, np.uint64)
        self.begin, self.length = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.first, self.count = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.bytes, self.ids = np.zeros(1 << 20, np.uint8), np.zeros(1 << 18, np.uint32)

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((keys >> np.uint64(64 - _SLOT_BITS)).astype(np.int64) + probe) & ((1 << _SLOT_BITS) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 where it is unknown."""
        out = np.full(len(keys), -1, np.int64)
        todo, own = None, keys
        for probe in range(_PROBES):
            entry = self.slots[self._slot(own, probe)]
            hit = (entry >= 0) & (self.key[entry] == own)
            if todo is None:
                out[hit] = entry[hit]
            else:
                out[todo[hit]] = entry[hit]
            more = np.flatnonzero((entry >= 0) & ~hit)
            if not len(more):
                break
            todo, own = more if todo is None else todo[more], own[more]
        return out

    @staticmethod
    def _grown(array: np.ndarray, need: int) -> np.ndarray:
        return array if need <= len(array) else np.concatenate([array, np.zeros(max(need, len(array) * 3 // 2) - len(array), array.dtype)])

    def add(self, keys: np.ndarray, raw: np.ndarray, lengths: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Add distinct unknown keys; their entries. An entry that finds no slot stays usable by its number only."""
        entries = np.arange(self.n, self.n + len(keys))
        for name, values in (("key", keys), ("begin", self.n_bytes + np.cumsum(lengths) - lengths), ("length", lengths), ("first", self.n_ids + np.cumsum(counts) - counts), ("count", counts)):
            held = self._grown(getattr(self, name), self.n + len(keys))
            held[self.n : self.n + len(keys)] = values
            setattr(self, name, held)
        self.bytes, self.ids = self._grown(self.bytes, self.n_bytes + len(raw)), self._grown(self.ids, self.n_ids + len(ids))
        self.bytes[self.n_bytes : self.n_bytes + len(raw)] = raw
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n, self.n_bytes, self.n_ids = self.n + len(keys), self.n_bytes + len(raw), self.n_ids + len(ids)
        left = np.arange(len(keys))
        for probe in range(_PROBES):
            slot = self._slot(keys[left], probe)
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[left[free]]  # of keys that want one slot the last gets it
            left = left[self.slots[slot] != entries[left]]
            if not len(left):
                break
        return entries


class Encoder:
    """Ids of batches of texts; one for each Python worker and vocabulary."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.folds = folds(json.loads(self.tokenizer.to_str()))
        self.known = Pieces()
        self.up = self.down = np.zeros(0, np.uint64)

    def plain(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per piece), each piece by the library."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)]
        return np.array([i for f in found for i in f], np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def window(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per piece) of the pieces of ``data`` between ``bounds`` (first is 0, last its length)."""
        n = len(data)
        if n >= len(self.up):
            self.up, self.down = _powers(_RADIX, n + 1), _powers(_INVERSE, n + 1)
        begin, length = bounds[:-1], np.diff(bounds)
        run = np.zeros(n + 1, np.uint64)
        np.add(data, 1, out=run[1:], dtype=np.uint64, casting="unsafe")
        run[1:] *= self.up[:n]
        np.cumsum(run, out=run)
        key = (run[bounds[1:]] - run[begin]) * self.down[begin]
        key = (key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        if self.known.n > CACHE_ENTRIES or self.known.n_bytes + n > TABLE_BYTES:
            self.known = Pieces()
        known = self.known
        entry = known.find(key)
        new = np.flatnonzero(entry < 0)
        if len(new):
            keys, first, which = np.unique(key[new], return_index=True, return_inverse=True)
            at = begin[new[first]]
            size = length[new[first]]
            raw = data.tobytes()
            pieces = [raw[a:b] for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)]
            ids, counts = self.plain(pieces)
            entry[new] = known.add(keys, np.frombuffer(b"".join(pieces), np.uint8), size, ids, counts)[which]
        # The hash only finds: each piece must equal its entry byte by byte, or the window is encoded without the table.
        same = np.array_equal(known.length[entry], length)
        if not same or not np.array_equal(known.bytes[np.repeat(known.begin[entry] - begin, length) + np.arange(n)], data):
            raw = data.tobytes()
            return self.plain([raw[a:b] for a, b in zip(begin.tolist(), bounds[1:].tolist(), strict=True)])
        counts = known.count[entry]
        source = np.repeat(known.first[entry] - (np.cumsum(counts) - counts), counts)
        source += np.arange(len(source))
        return known.ids[source], counts

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids (uint32) of each text in turn; null counts as empty. Works on about WINDOW bytes at a time."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + WINDOW, "right")))
            yield from self._encode(texts.slice(low, high - low))
            low = high

    def _encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, values = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if self.folds:
            data = _FOLD[data]
        starts = np.append(cuts(data, offsets), len(data)) if len(data) else np.zeros(1, np.int64)
        pending: list[np.ndarray] = []
        text, at = 0, 0
        while at < len(starts) - 1:
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + WINDOW, "right")) - 1)
            low, high = int(starts[at]), int(starts[to])
            ids, counts = self.window(data[low:high], starts[at : to + 1] - low)
            before = np.concatenate([[0], np.cumsum(counts)])
            last = int(np.searchsorted(offsets, high, "right")) - 1  # texts that end in this window
            ends = before[np.searchsorted(starts[at : to + 1], offsets[text + 1 : last + 1])]
            done = 0
            for e in ends.tolist():
                pending.append(ids[done:e])
                yield np.concatenate(pending) if len(pending) > 1 else pending[0]
                pending, done = [], e
            if done < len(ids):
                pending.append(ids[done:])
            text, at = last, to
        for _ in range(text, len(texts)):
            yield np.zeros(0, np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
