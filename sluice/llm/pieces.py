"""SentencePiece encoding with byte offsets, and decoding, from a model file alone.

Normalisation follows the model's compiled character map: at each place the longest entry of its double-array trie is replaced, otherwise one
character is copied, and every normalised character records the source byte where it began. Pieces are found by merging the best-scored adjacent
pair (BPE models); unknown characters fall back to bytes. Projecting piece borders through the alignment gives byte spans that tile the source.

Text is cut before each escaped space, where no piece can reach over. All words of a chunk of texts that aren't known yet are merged
together and their encodings kept in a bounded cache, from which those of the texts are gathered.

Defined cases: null text counts as empty; an empty text has the end id only (if asked for); repeated rows are encoded one by one; an empty
table gives an empty table; other columns are ignored; bytes that aren't UTF-8 count as U+FFFD; a very long text is a chunk of its own. Models with user-defined or unused pieces, and other than BPE, are refused.
"""

from __future__ import annotations

import functools
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluice.llm.batches import chunks, map_batches, texts_of

SPACE = "▁"
CACHE = 1_500_000  #: characters of the words whose encodings a worker keeps
CHUNK = 1 << 18  #: bytes of texts that are encoded together
_NONE = 1 << 62
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message; lengths-delimited values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            at += size
            yield number, data[at - size : at]


class Normalizer:
    """``map`` is the compiled character map: the trie's size, its units, then the replacements, each ended by a zero byte."""

    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, squeeze: bool = True, escape: bool = True):
        self.dummy_prefix, self.squeeze, self.space = dummy_prefix, squeeze, SPACE if escape else " "
        size = struct.unpack_from("<I", charsmap)[0] if charsmap else 0
        self.units = np.frombuffer(charsmap, "<u4", size // 4, 4).tolist() if size else []
        self.texts = charsmap[4 + size :]

    def _longest(self, raw: bytes, at: int) -> tuple[int, int] | None:
        """(length, place of the replacement) of the longest entry that starts at ``at``."""
        units, found = self.units, None
        node = self._child(units[0], 0)
        for k in range(at, len(raw)):
            node ^= raw[k]
            if node >= len(units) or units[node] & 0x800000FF != raw[k]:
                break
            unit = units[node]
            node = self._child(unit, node)
            if unit >> 8 & 1:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        return found

    @staticmethod
    def _child(unit: int, node: int) -> int:
        return node ^ (unit >> 10 << ((unit >> 6) & 8))

    def _prefixes(self, raw: bytes):
        """(start, length, replacement) of each prefix in turn."""
        at = 0
        while at < len(raw):
            hit = self._longest(raw, at) if self.units else None
            if hit:
                n, place = hit
                yield at, n, self.texts[place : self.texts.index(0, place)].decode()
            else:
                lead = raw[at]
                n = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
                yield at, n, raw[at : at + n].decode()
            at += n

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters (and its end) the byte of the source where it began."""
        raw = text.encode()
        if not self.units and not self.squeeze:  # without a map no prefix has an entry: every character is copied
            out = text.replace(" ", self.space)
            b = np.frombuffer(raw, np.uint8)
            origin = np.append(np.flatnonzero((b & 0xC0) != 0x80), len(raw))
            if out and self.dummy_prefix:
                return self.space + out, np.insert(origin, 0, 0)
            return out, origin
        parts, origin, started, gap = [], [], False, False
        end = len(raw) if not self.squeeze else 0
        for at, n, new in self._prefixes(raw):
            for c in new:
                if c == " " and self.squeeze and (gap or not started):
                    continue
                if not started:
                    started = True
                    if self.dummy_prefix:
                        parts.append(self.space)
                        origin.append(at)
                gap = c == " "
                parts.append(self.space if gap else c)
                origin.append(at)
            if new.strip(" ") or not self.squeeze:
                end = at + n
        if self.squeeze and gap:
            parts.pop()
            origin.pop()
        return "".join(parts), np.array([*origin, end], np.int64)


class _Merges:
    """All merges of a vocabulary as one open hash table over pairs of symbols, so that many words are merged at once.

    A symbol is a piece, or a character that some piece holds; 0 is any other character and never merges.
    """

    def __init__(self, score: dict[str, float]):
        names = [*score, *sorted({c for p in score for c in p} - set(score))]
        number = {n: i + 1 for i, n in enumerate(names)}
        self.symbol = np.zeros(0x110000, np.int32)  # by code point
        for n, i in number.items():
            if len(n) == 1:
                self.symbol[ord(n)] = i
        by_score = {v: k for k, v in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = np.full(len(names) + 1, _NONE >> 32, np.int64)
        self.rank[1 : len(score) + 1] = [by_score[v] for v in score.values()]
        found = [(number.get(p[:k]), number.get(p[k:]), number[p]) for p in score for k in range(1, len(p))]
        pairs = np.array([f for f in found if f[0] and f[1]], np.int64).reshape(-1, 3)
        self.shift = 64 - max(4, (4 * len(pairs)).bit_length())
        self.keys = np.zeros(1 << 64 - self.shift, np.int64)
        self.made = np.zeros(len(self.keys), np.int32)
        keys, made = pairs[:, 0] << 32 | pairs[:, 1], pairs[:, 2]
        slot = self._slot(keys)
        while len(keys):
            slot, first = slot % len(self.keys), np.zeros(len(keys), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = first & (self.keys[slot] == 0)
            self.keys[slot[put]], self.made[slot[put]] = keys[put], made[put]
            keys, made, slot = keys[~put], made[~put], slot[~put] + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that each pair makes, 0 where it makes none."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.made[slot], 0)
        open_ = np.flatnonzero((held != keys) & (held != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.made[slot[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
        return out

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, characters in each, symbols a word) after all merges: in each word, again and again, the adjacent pair of the best score, the leftmost among equals."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths)
        starts = ends - lengths
        symbols = self.symbol[np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le"), np.uint32)]
        symbols[ends - 1] = 0  # a place between words
        n = len(symbols)
        after, before, size, gone = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, np.int32), np.zeros(n, bool)
        gone[ends - 1] = True
        made = np.append(self.pair(symbols[:-1], symbols[1:]), 0)
        key = self.rank[made] << 32 | np.arange(n)
        while True:
            best = np.minimum.reduceat(key, starts)
            at = best[best < _NONE] & 0xFFFFFFFF
            if not len(at):
                break
            right = after[at]
            symbols[at] = made[at]
            size[at] += size[right]
            gone[right], key[right] = True, _NONE
            after[at] = after[right]
            before[after[at]] = at
            left = before[at]
            both = np.concatenate([at, left[left >= 0]])
            made[both] = self.pair(symbols[both], symbols[after[both]])
            key[both] = self.rank[made[both]] << 32 | both
        return symbols[~gone], size[~gone], np.add.reduceat((~gone).astype(np.int64), starts)


class _Words(dict):
    """Word -> its number; a word that isn't there gets the next one and is put into ``new``. Encodings are flat arrays with a start and a count a word."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.ids, self.sizes = np.empty(0, np.int32), np.empty(0, np.int32)
        self.starts, self.counts, self.hits = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.chars = 0

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.new.append(word)
        return i

    def add(self, ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        """The encodings of the new words, in their order; starts count from the first of ``ids``."""
        self.starts, self.counts = np.concatenate([self.starts, len(self.ids) + starts]), np.concatenate([self.counts, counts])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        self.hits = np.concatenate([self.hits, np.zeros(len(counts), np.int64)])
        self.chars += sum(map(len, self.new))
        self.new = []

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, sizes, where each word's begin and the last's end) of words by number."""
        counts = self.counts[which]
        before = np.concatenate(([0], np.cumsum(counts)))
        place = np.repeat(self.starts[which] - before[:-1], counts) + np.arange(before[-1])
        return self.ids[place], self.sizes[place], before

    def trim(self) -> None:
        """Keep what was used again since the last time, if that is little enough, else nothing."""
        again = np.flatnonzero(self.hits > 1)
        words = list(self)
        words = [words[i] for i in again]
        if 2 * sum(map(len, words)) > CACHE:
            again, words = again[:0], []
        self.ids, self.sizes, before = self.gather(again)
        self.starts, self.counts, self.hits = before[:-1], np.diff(before), np.zeros(len(again), np.int64)
        self.clear()
        self.update(zip(words, range(len(words)), strict=True))
        self.chars = sum(map(len, words))


class Encoded:
    """Encodings of several texts: flat arrays, with the bounds of each text in them."""

    def __init__(self, ids, begins, ends, bounds):
        self.ids, self.begins, self.ends, self.bounds = ids, begins, ends, bounds

    def lists(self) -> list[list[int]]:
        flat, bounds = self.ids.tolist(), self.bounds.tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]  # noqa: B905


class PieceModel:
    def __init__(self, path: str):
        self.names, self.kinds, self.score = [], [], {}
        norm, trainer = {}, {}
        for number, value in _fields(open(path, "rb").read()):
            if number == 1:
                piece = dict(_fields(value))
                self.names.append(piece[1].decode())
                self.kinds.append(piece.get(3, _NORMAL))
                if self.kinds[-1] == _NORMAL:
                    self.score[self.names[-1]] = struct.unpack("<f", piece[2])[0]
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        if trainer.get(3, 1) != 2 or {4, 5} & set(self.kinds) or trainer.get(24, 0):
            raise ValueError("only BPE models without user-defined or unused pieces and with spaces in front are supported")
        self.normalizer = Normalizer(norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1)))
        self.unknown = self.kinds.index(_UNKNOWN)
        self.end = next((i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if n == "</s>" and k == _CONTROL), None)
        self.bytes = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == _BYTE} if trainer.get(35) else {}
        self.id = {n: i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == _NORMAL}
        if any(SPACE in n.lstrip(SPACE) for n in self.id):
            raise ValueError("a piece holds a space after another character")
        self.line_breaks = any("\n" in n for n in self.id)
        unk = trainer.get(44, b" \xe2\x81\x87 ")
        self.surface = [n.replace(SPACE, " ").encode() for n in self.names]
        for i, k in enumerate(self.kinds):
            if k in (_UNKNOWN, _CONTROL):
                self.surface[i] = unk if k == _UNKNOWN else b""
            elif k == _BYTE:
                self.surface[i] = bytes([int(self.names[i][3:5], 16)])
        self.decimal = [b" %d" % i for i in range(len(self.names))]
        self.merges = _Merges(self.score)
        self.of_symbol = np.full(len(self.merges.rank), -1, np.int32)
        self.of_symbol[1 : len(self.score) + 1] = [self.id[n] for n in self.score]
        self.cache = _Words()

    def merge(self, word: str) -> list[str]:
        """The word's characters after all merges: each time the adjacent pair of the best score, the leftmost among equals."""
        score, parts = self.score.get, list(word)
        if len(parts) <= 24:
            pairs = [score(a + b) for a, b in zip(parts, parts[1:])]  # noqa: B905
            while True:
                best, at = None, -1
                for i, s in enumerate(pairs):
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if best is None:
                    return parts
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                del pairs[at]
                if at < len(pairs):
                    pairs[at] = score(parts[at] + parts[at + 1])
                if at:
                    pairs[at - 1] = score(parts[at - 1] + parts[at])
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := score(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, parts[i] + parts[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, whole = heapq.heappop(heap)
            if right[i] != j or not parts[i] or not parts[j] or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p]

    def word(self, word: str) -> tuple[list[int], list[int]]:
        """Ids, and how many normalised characters each ends after the one before (all bytes of a character but the last: 0)."""
        ids, sizes = [], []
        for piece in self.merge(word):
            i = self.id.get(piece)
            if i is not None:
                ids.append(i)
                sizes.append(len(piece))
            elif self.bytes:
                raw = piece.encode()
                ids += [self.bytes[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [1]
            else:
                ids.append(self.unknown)
                sizes.append(1)
        return ids, sizes

    def _learn(self) -> None:
        """Encode the cache's new words: short ones are merged together, long ones and those with bytes or unknown characters one by one."""
        words = self.cache.new
        short = np.flatnonzero(np.fromiter(map(len, words), np.int64, len(words)) <= 32)
        slow, starts, counts = np.ones(len(words), bool), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        ids, sizes = np.empty(0, np.int32), np.empty(0, np.int32)
        if len(short):
            symbols, sizes, n = self.merges.words([words[i] for i in short])
            ids, first = self.of_symbol[symbols], np.cumsum(n) - n
            slow[short] = np.add.reduceat((ids < 0).astype(np.int64), first) > 0
            starts[short], counts[short] = first, n
        more: list = [[], []]
        for i in np.flatnonzero(slow).tolist():
            found = self.word(words[i])
            starts[i], counts[i] = len(ids) + len(more[0]), len(found[0])
            more[0] += found[0]
            more[1] += found[1]
        self.cache.add(np.concatenate([ids, np.array(more[0], np.int32)]), np.concatenate([sizes, np.array(more[1], np.int32)]), starts, counts)

    def encode_all(self, texts: list[str], add_end: bool = False) -> Encoded:
        """Encodings of all texts, with the first and the last-but-one byte border of each piece in its text's UTF-8."""
        split = (_WORDS if self.line_breaks else _WORDS_AND_LINES).findall
        words, bounds, origins = [], [0], []
        for t in texts:
            norm, origin = self.normalizer(t)
            # A word is a run of spaces and what follows, or, where no piece holds a line break, ends before one and starts anew after it.
            words += split(norm)
            bounds.append(len(words))
            origins.append(origin)
        c = self.cache
        if c.chars > CACHE:
            c.trim()
        which = np.fromiter(map(c.__getitem__, words), np.int64, len(words))
        if c.new:
            self._learn()
        c.hits += np.bincount(which, minlength=len(c))
        ids, sizes, before = c.gather(which)
        limits = before[bounds]
        # Normalised characters before each piece's end, counted from its text's start, then the source byte where the next one began.
        ends, per = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), np.diff(limits)
        lengths = np.fromiter(map(len, origins), np.int64, len(origins))
        borders = np.concatenate([*origins, np.empty(0, np.int64)])[ends[1:] + np.repeat(np.cumsum(lengths) - lengths - ends[limits[:-1]], per)]
        if not self.bytes and len(ids):  # neighbouring unknown characters are one piece
            owner = np.repeat(np.arange(len(texts)), per)
            last = np.append((ids[1:] != self.unknown) | (ids[:-1] != self.unknown) | (owner[1:] != owner[:-1]), True)
            ids, borders, limits = ids[last], borders[last], np.searchsorted(owner[last], np.arange(len(texts) + 1))
        begins = np.concatenate(([0], borders[:-1])) if len(ids) else borders
        begins[limits[:-1][np.diff(limits) > 0]] = 0
        if add_end:
            whole = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
            ids, begins, borders = np.insert(ids, limits[1:], self.end), np.insert(begins, limits[1:], whole), np.insert(borders, limits[1:], whole)
            limits = limits + np.arange(len(texts) + 1)
        return Encoded(ids.astype(np.int32), begins.astype(np.int32), borders.astype(np.int32), limits)

    def encode(self, text: str, add_end: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and the first and the last-but-one byte border of each in the source's UTF-8."""
        e = self.encode_all([text], add_end)
        return e.ids, e.begins, e.ends

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if self.kinds[i] != _CONTROL), None)
        if first is not None and self.names[first].startswith(SPACE) and (self.normalizer.dummy_prefix or self.normalizer.squeeze):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:  # each byte that can't be read is one replacement character
            return raw.decode(errors="surrogateescape").translate(_BROKEN)


_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_WORDS_AND_LINES = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
_BROKEN = {0xDC00 + b: "�" for b in range(256)}


@functools.lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


#: What ``encode`` can return for each text; ``begins`` and ``ends`` are each piece's byte borders in it, ``ids_text`` the decimal ids joined by one space.
OUTPUTS = {"ids": "array<int>", "begins": "array<int>", "ends": "array<int>", "ids_text": "string", "decoded": "string"}


def _columns(m: PieceModel, e: Encoded, outputs: tuple[str, ...]) -> list[pa.Array]:
    offsets, lists = pa.array(e.bounds.astype(np.int32)), e.lists() if {"ids_text", "decoded"} & set(outputs) else []
    made = {
        **{k: lambda k=k: pa.ListArray.from_arrays(offsets, pa.array(getattr(e, k), pa.int32())) for k in ("ids", "begins", "ends")},
        "ids_text": lambda: pa.array([b"".join(map(m.decimal.__getitem__, x))[1:] for x in lists], pa.binary()).cast(pa.string()),
        "decoded": lambda: pa.array(list(map(m.decode, lists)), pa.string()),
    }
    return [made[k]() for k in outputs]


def _fields_of(df: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema)


def encode(df: DataFrame, model: str, *, text: str = "text", keep: list[str], add_end: bool = True, outputs: tuple[str, ...] = ("ids", "begins", "ends")) -> DataFrame:
    """``keep`` columns plus ``outputs``, see ``OUTPUTS``."""

    def run(batch: pa.RecordBatch):
        m, texts = load(model), texts_of(batch.column(batch.num_columns - 1))
        for a, b in chunks(texts, CHUNK):
            e = m.encode_all([t.decode(errors="replace") for t in texts[a:b]], add_end)
            yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[:-1]], *_columns(m, e, outputs)], names=[*keep, *outputs])

    return map_batches(df.select(*keep, F.col(text).alias("__text")), run, _fields_of(df, keep) + ", ".join(f"{k} {OUTPUTS[k]}" for k in outputs))


def decode(df: DataFrame, model: str, *, ids: str = "ids", keep: list[str], name: str = "decoded") -> DataFrame:
    """``keep`` columns plus the text of the ids."""

    def run(batch: pa.RecordBatch):
        m, column = load(model), batch.column(batch.num_columns - 1)
        texts = [m.decode(column[i].values.to_numpy().tolist() if column[i].is_valid else []) for i in range(len(column))]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, name])

    return map_batches(df.select(*keep, F.col(ids).alias("__ids")), run, _fields_of(df, keep) + f"`{name}` string")
