"""Batch encoding with a public tokenizer file: distinct space-separated segments are encoded once and reused."""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Segments whose ids a worker keeps; beyond it those met once are forgotten, so its memory is bounded.
CACHE_SEGMENTS = 400_000

#: New segments that are encoded as one joined text.
JOINED = 256

_ENCODERS: dict[str, Encoder] = {}

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x0A]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?|$%&*#")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file (never copied)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _cuts(data: np.ndarray) -> np.ndarray:
    """Offsets at which both pre-tokenizers in use surely start a new piece, so that the parts encode independently.

    They are: a single space or line feed between two characters that are surely not white space (and
    the place after the line feed), and an ASCII letter's end before common punctuation. A neighbour
    that might be a wide white space (lead bytes C2, E1-E3) is left alone.
    """
    if len(data) < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(_BREAK[data[1:-1]]) + 1
    before, after = data[at - 1], data[at + 1]
    bad = _SPACE[before] | _SPACE[after] | _WIDE[after] | _WIDE[data[np.maximum(at - 2, 0)]] | _WIDE[data[np.maximum(at - 3, 0)]] & (before >= 0x80)
    at = at[~bad]
    stops = np.flatnonzero(_STOP[data[1:]] & _LETTER[data[:-1]]) + 1
    return np.concatenate([at, at[data[at] == 0x0A] + 1, stops])


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own encoding of each text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = {t.content for t in added}
        self.marks = re.compile(b"|".join(re.escape(c.encode()) for c in sorted(self.added, key=len, reverse=True))) if self.added else None
        #: Texts may be cut; else some added token is looked for in another way than as a plain string, and texts stay whole.
        self.cuts = not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added)
        self.separator, self.separator_id = "", -1
        for mark in ("\n", " \u00bd "):
            alone = self.tokenizer.encode("a", add_special_tokens=False).ids
            joined = self.tokenizer.encode(f"a{mark}a", add_special_tokens=False).ids
            if len(joined) == 2 * len(alone) + 1 and joined[: len(alone)] == alone == joined[len(alone) + 1 :]:
                self.separator, self.separator_id = mark, joined[len(alone)]
                break
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.again = np.zeros(1 << 14, bool)

    def _forget(self) -> None:
        """Keep only the segments that were met in a second slice; most are met once. All go if too many are left."""
        kept = {s: i for s, i in self.known.items() if self.again[i]}
        if 2 * len(kept) > CACHE_SEGMENTS:
            self._reset()
            return
        at = np.fromiter(kept.values(), np.int64, len(kept))
        lengths = self.length[at]
        ends = np.cumsum(lengths)
        flat = self.pool[np.repeat(self.start[at] - ends + lengths, lengths) + np.arange(int(lengths.sum()))]
        self._reset()
        self._add(list(kept), flat, lengths)

    def _add(self, new: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        first = len(self.known)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while first + len(new) > len(self.start):
            self.start, self.length, self.again = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.length, self.again))
        self.pool[self.used : self.used + len(flat)] = flat
        self.start[first : first + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.length[first : first + len(new)] = lengths
        self.used += len(flat)
        self.known.update(zip(new, range(first, first + len(new))))

    def _encoded(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments, length of each). Segments go in joined by a separator that is a piece of its own.

        No segment holds the separator's character, so if a joined text shows as many separators as
        went in, none of them met a neighbour and the parts are what each segment gives alone;
        otherwise the segments of that text are encoded one by one.
        """
        each = self.tokenizer.encode_batch_fast
        if not self.separator:
            ids = [e.ids for e in each(segments, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))
        groups = [segments[i : i + JOINED] for i in range(0, len(segments), JOINED)]
        flat, lengths = [], []
        for group, e in zip(groups, each([self.separator.join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            at = np.flatnonzero(ids == self.separator_id)
            if len(at) == len(group) - 1:
                flat.append(np.delete(ids, at))
                lengths.append(np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1)
            else:
                own = [x.ids for x in each(group, add_special_tokens=False)]
                flat.append(np.fromiter(chain.from_iterable(own), np.uint32))
                lengths.append(np.fromiter(map(len, own), np.int64, len(own)))
        return np.concatenate(flat), np.concatenate(lengths)

    def _places(self, segments: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_SEGMENTS:
            self._forget()
        known, before = self.known, len(self.known)
        fresh = [s for s in segments if s not in known]
        mark = self.separator.strip(" ")
        alone = fresh if not self.cuts else [s for s in fresh if mark in s or s in self.added] if mark else []
        apart = set(alone)
        for new, whole in ((fresh if not alone else [s for s in fresh if s not in apart], False), (alone, True)):
            if not new:
                continue
            if whole:
                ids = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
                flat, lengths = np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))
            else:
                flat, lengths = self._encoded(new)
            self._add(new, flat, lengths)
        places = np.fromiter(map(known.__getitem__, segments), np.int64, len(segments))
        self.again[places[places < before]] = True
        return places

    def _around_added(self, data: np.ndarray, texts: np.ndarray, edges: np.ndarray) -> None:
        """Set edges around each added token's string in a text and none in it: the tokenizer splits a text there first."""
        if self.marks is None or not len(data):
            return
        raw = data.tobytes()
        if not any(c.encode() in raw for c in self.added):
            return
        for start, end in zip(texts[:-1].tolist(), texts[1:].tolist()):
            for m in self.marks.finditer(raw, start, end):
                edges[m.start() + 1 : m.end()] = False
                edges[[m.start(), m.end()]] = True

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each ended by end_id; offsets of the texts). Null: empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        n = len(texts)
        texts = pa.concat_arrays([texts]) if texts.offset == 0 else pa.array(texts.to_pylist(), pa.string())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[: n + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw is not None and offsets[-1] else np.zeros(0, np.uint8)
        edges = np.zeros(len(data) + 1, bool)
        edges[offsets] = True
        inside = np.flatnonzero(edges)
        if self.cuts:
            edges[_cuts(data)] = True
            self._around_added(data, inside, edges)
        edges[inside] = True
        edges[len(data)] = True
        edges[0] = True
        at = np.flatnonzero(edges).astype(np.int32)
        if len(data):
            parts = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), raw).dictionary_encode()
            place = self._places(parts.dictionary.to_pylist())[parts.indices.to_numpy()]
            lengths, starts = self.length[place], self.start[place]
        else:
            lengths = starts = np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        text_ends = ends[np.searchsorted(at, offsets)]
        total = int(ends[-1])
        flat = self.pool[np.repeat(starts - ends[:-1], lengths) + np.arange(total)] if total else np.zeros(0, np.uint32)
        return np.insert(flat, text_ends[1:], np.uint32(end_id)), text_ends + np.arange(n + 1)


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
