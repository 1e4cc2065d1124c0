"""Word and line statistics of a batch of whole texts, computed on the UTF-8 bytes of all texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 5

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: ASCII that is neither a letter nor a digit.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

#: Classes of a byte; every byte has one.
OTHER, BLANK, UPPER, DIGIT, STOP, BANG, PIPE, SYMBOL, WIDE, LATER = range(10)
_CLASS = np.zeros(256, np.uint8)
for _kind, _chars in ((BLANK, b" \t\n\x0b\x0c\r"), (UPPER, bytes(range(65, 91))), (DIGIT, b"0123456789"), (STOP, b".,;:?"), (BANG, b"!"), (PIPE, b"|"), (SYMBOL, b"#*$%&<>"), (WIDE, bytes(range(0xC0, 0x100))), (LATER, bytes(range(0x80, 0xC0)))):
    _CLASS[list(_chars)] = _kind


@dataclass
class Words:
    """Words of n texts: code of each word (equal codes, equal words), the text of each word, and the distinct words."""

    n: int
    data: np.ndarray
    offsets: np.ndarray
    blank: np.ndarray
    code: np.ndarray
    doc: np.ndarray
    distinct: pa.Array
    per_doc: np.ndarray

    def classes(self) -> np.ndarray:
        """Bytes of each text (row) by class (column); LATER are the bytes of a character after its first."""
        owner = np.repeat(np.arange(self.n, dtype=np.int32) * 16, np.diff(self.offsets))
        return np.bincount(owner + _CLASS[self.data], minlength=16 * self.n).reshape(self.n, 16)[:, :10]


def _strings(data: np.ndarray, lengths: np.ndarray) -> pa.DictionaryArray:
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()


@dataclass
class Spans:
    """Where the words of n texts lie in their (perhaps lower-cased) bytes: first byte and length of each, and its text."""

    n: int
    data: np.ndarray
    offsets: np.ndarray
    blank: np.ndarray
    at: np.ndarray
    lengths: np.ndarray
    doc: np.ndarray


def spans(texts: pa.Array, separator: np.ndarray | None = None, lower: bool = False, characters: bool = False) -> Spans:
    """Words between ASCII white space (or the bytes separator marks) of every text, A-Z lower-cased on request; null: none.

    With characters, each character of a script that puts no spaces between words is a word of its own.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if texts.offset:
        texts = pa.array(texts.to_pylist(), pa.string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[: n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw is not None and offsets[-1] else np.zeros(0, np.uint8)
    if lower:
        data = _LOWER[data]
    blank = (_BLANK if separator is None else separator)[data]
    inside = ~blank
    first = inside.copy()
    first[1:] &= blank[:-1] if len(data) else first[1:]
    starts_doc = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts_doc] = inside[starts_doc]
    if characters and (data >= 0xE0).any():
        begin, after = _unspaced(data)
        first[begin] = True
        first[after] = inside[after]
    at = np.flatnonzero(first)
    last = inside
    last[:-1] &= blank[1:] | first[1:]
    return Spans(n, data, offsets, blank, at, np.flatnonzero(last) - at + 1, np.searchsorted(offsets, at, side="right") - 1)


def _unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of characters of Thai, Lao, Burmese, Khmer, Chinese and Japanese script, and the bytes after such characters."""
    lead = np.flatnonzero((data >= 0xE0) & (data <= 0xF0))
    kind, then = data[lead], data[np.minimum(lead + 1, len(data) - 1)]
    of = (kind >= 0xE3) & (kind <= 0xE9) | (kind == 0xE0) & (then >= 0xB8) & (then <= 0xBB) | (kind == 0xE1) & ((then >= 0x80) & (then <= 0x82) | (then == 0x9E) | (then == 0x9F)) | (kind == 0xF0) & (then >= 0xA0) & (then <= 0xB3)
    begin = lead[of]
    after = begin + np.where(kind[of] == 0xF0, 4, 3)
    return begin, after[after < len(data)]


def words(texts: pa.Array, separator: np.ndarray | None = None, lower: bool = False, characters: bool = False) -> Words:
    """The words of spans() with the code of each and the distinct words."""
    s = spans(texts, separator, lower, characters)
    if len(s.at):
        coded = _strings(s.data[~s.blank], s.lengths)
        code, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    else:
        code, distinct = np.zeros(0, np.int64), pa.array([], pa.string())
    return Words(s.n, s.data, s.offsets, s.blank, code, s.doc, distinct, np.bincount(s.doc, minlength=s.n).astype(np.int64))


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256).astype(np.uint64)


class Rolling:
    """64-bit hashes of any stretches of some bytes, all bytes of a stretch read, from one pass over them."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        power, self.back = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _BACK, np.uint64)
        power[0] = self.back[0] = 1
        np.cumprod(power, out=power)
        np.cumprod(self.back, out=self.back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:n], out=self.sums[1:])

    def hashes(self, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        h = (self.sums[at + lengths] - self.sums[at]) * self.back[at] + lengths.astype(np.uint64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(27))


def _window_keys(owner: np.ndarray, ids: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of each window and its text."""
    key = owner.astype(np.uint64)
    for x in ids:
        key = (key ^ x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def repeated_words(w: Words, size: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a window of size words found twice or more in it (the first included)."""
    total = len(w.code)
    if total < size:
        return np.zeros(w.n, np.int64)
    at = np.flatnonzero(w.doc[: total - size + 1] == w.doc[size - 1 :])
    ids = [w.code[at + j] for j in range(size)]
    owner = w.doc[at]
    key = _window_keys(owner, ids)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    a, b = order[1:][same], order[:-1][same]
    if not all((x[a] == x[b]).all() for x in [owner, *ids]):  # different windows of one hash: order by the words themselves
        order = np.lexsort([*ids, owner])
        same = np.ones(len(order) - 1, bool)
        for x in [owner, *ids]:
            same &= x[order][1:] == x[order][:-1]
        a, b = order[1:][same], order[:-1][same]
    cover = np.zeros(total + 1, np.int64)
    again = at[np.unique(np.concatenate([a, b]))]
    np.add.at(cover, again, 1)
    np.subtract.at(cover, again + size, 1)
    covered = np.cumsum(cover[:-1]) > 0
    return np.bincount(w.doc[covered], minlength=w.n).astype(np.int64)


def duplicate_lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, such lines equal to an earlier line of the text) of each text."""
    if not len(w.data):
        return np.zeros(w.n, np.int64), np.zeros(w.n, np.int64)
    feed = w.data == 0x0A
    edge = np.zeros(len(w.data) + 1, bool)
    edge[w.offsets] = True
    edge[1:][feed] = True
    at = np.flatnonzero(edge)
    begin, end = at[:-1], at[1:]
    solid = np.concatenate([[0], np.cumsum(~w.blank, dtype=np.int32)])
    wordy = solid[end] > solid[begin]
    kept = np.concatenate([[0], np.cumsum(~feed, dtype=np.int32)])
    code = _strings(w.data[~feed], kept[end] - kept[begin]).indices.to_numpy().astype(np.int64)[wordy]
    doc = (np.searchsorted(w.offsets, begin, side="right") - 1)[wordy]
    lines = np.bincount(doc, minlength=w.n).astype(np.int64)
    distinct = np.unique(doc * (len(wordy) + 1) + code) // (len(wordy) + 1)
    return lines, lines - np.bincount(distinct, minlength=w.n)


def rule_stats(w: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    c = w.classes()
    return {
        "n_words": w.per_doc,
        "word_chars": c.sum(axis=1) - c[:, BLANK] - c[:, LATER],
        "n_symbols": c[:, SYMBOL] + c[:, PIPE],
        "n_dup_lines": duplicate_lines(w)[1],
        "n_repeat_words": repeated_words(w),
    }


FEATURES = [
    "log_words", "word_length", "symbol_share", "upper_share", "digit_share", "stop_share", "bang_share", "pipe_share", "wide_share",
    "words_per_line", "dup_line_share", "repeat_share", "distinct_share", "stutter_share", "blank_share",
]


def features(texts: pa.Array) -> np.ndarray:
    """One row a text of the FEATURES above: shares and means that stay comparable over lengths. Empty texts: zeros."""
    w = words(texts)
    lines, dup = duplicate_lines(w)
    n = np.maximum(w.per_doc, 1)
    c = w.classes()
    chars = c.sum(axis=1) - c[:, LATER]
    solid = np.maximum(chars - c[:, BLANK], 1)
    pairs = np.unique(w.doc * (len(w.distinct) + 1) + w.code) // (len(w.distinct) + 1)
    stutter = np.flatnonzero((w.code[1:] == w.code[:-1]) & (w.doc[1:] == w.doc[:-1]))
    columns = [
        np.log1p(w.per_doc), solid / n, (c[:, SYMBOL] + c[:, PIPE]) / solid, c[:, UPPER] / solid, c[:, DIGIT] / solid, c[:, STOP] / solid, c[:, BANG] / solid, c[:, PIPE] / solid, c[:, WIDE] / solid,
        w.per_doc / np.maximum(lines, 1), dup / np.maximum(lines, 1), repeated_words(w) / n, np.bincount(pairs, minlength=w.n) / n, np.bincount(w.doc[stutter], minlength=w.n) / n, c[:, BLANK] / np.maximum(chars, 1),
    ]
    return np.stack(columns, axis=1).astype(np.float32)
