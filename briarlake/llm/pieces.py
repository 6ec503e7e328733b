"""SentencePiece encoding and decoding by batched numpy Viterbi.

Texts are cut into units at places that no piece crosses, and each distinct unit
is encoded once. Units of equal length advance together: rolling hashes of all
substrings probe the sorted hashes of the pieces, and at every position a
vectorised maximum over the piece lengths stores the backpointer.

A unigram model scores a path by the sum of its pieces' scores. In a BPE model
the merges decide, not the sum: there a step is allowed only if the two pieces
that it joins stay apart when BPE runs on both together. Exactly one path of
allowed steps exists, and it is the result of the merges; so the same lattice
gives the library's ids. That every path spells its unit is checked; a unit for
which two hashes met takes a plain way through the pieces themselves. In a BPE
model so do two kinds of units, with the same ids: those of over LONG_UNIT
characters (a lattice of one row) and those with runs of spaces (whose pieces
tie). Of the test documents' distinct units they are under one in a thousand.

Defined results: a null text has null ids and 0 tokens and counts as restored;
an empty text has no ids. U+2581 is how the format writes a space, so a text
that holds it decodes with a space there and is reported as not restored.
Repeated rows each get their ids; columns beside doc_id and text are left out,
whatever their names; texts are read whole.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briarlake.llm.text import named, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, BYTE, UNIGRAM, BPE = 1, 2, 6, 1, 2
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Longer units take the heap of merges: the lattice would be long and narrow.
LONG_UNIT = 200
#: Distinct units that a task remembers: about 50 MB.
REMEMBERED = 250_000
#: Units whose ids are put together at once.
PART_UNITS = 100_000


class _Collision(Exception):
    """A path doesn't spell its unit: the hashes of two different strings are equal."""


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if tag & 7 == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Pieces:
    """The pieces of a model file, as the lattice needs them."""

    def __init__(self, path: str = MODEL):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer, normalizer = {}, {}
        with open(path, "rb") as file:
            for number, value in _fields(file.read()):
                if number == 1:
                    piece = dict(_fields(value))
                    self.pieces.append(piece[1].decode())
                    self.scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                    self.types.append(piece.get(3, NORMAL))
                elif number == 2:
                    trainer = dict(_fields(value))
                elif number == 3:
                    normalizer = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.prefix = bool(normalizer.get(3, 1))
        if normalizer.get(2) or normalizer.get(4, 1):
            raise ValueError("only models that keep texts as they are can be decoded exactly")
        self.byte_ids = [0] * 256
        self.ids: dict[str, int] = {}
        self.unknown = 0
        for k, (piece, kind) in enumerate(zip(self.pieces, self.types, strict=True)):
            if kind == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = k
            elif kind == UNKNOWN:
                self.unknown = k
            elif kind == NORMAL:
                self.ids[piece] = k
        self.byte_fallback = BYTE in self.types
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space after other characters: units can't be cut there")
        self.longest = max(map(len, self.ids))
        # If no piece joins a letter with anything but letters (and spaces before), units can be cut there too.
        mixed = any(a.isalpha() != b.isalpha() for p in self.ids for a, b in zip(p.lstrip(SPACE), p.lstrip(SPACE)[1:]))
        self.cut = re.compile(f"\n+|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if mixed else f"\n+|{SPACE}*[^\\W\\d_]+|{SPACE}*(?:[^\\w{SPACE}\n]|[\\d_])+|{SPACE}+")
        self._tables()

    def _tables(self) -> None:
        v = len(self.pieces)
        self.surface = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for value, k in enumerate(self.byte_ids):
            if self.types[k] == BYTE:
                self.surface[k] = bytes([value])
        self.surface[self.unknown] = " ⁇ ".encode()
        for k, kind in enumerate(self.types):
            if kind not in (NORMAL, BYTE, UNKNOWN):
                self.surface[k] = b""
        self.surface_width = np.array(list(map(len, self.surface)), np.int64)
        self.surface_start = np.cumsum(self.surface_width) - self.surface_width
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        # Two more codes: a character that is no piece, and the edge of the unit. Neither ever merges.
        self.none, self.edge, self.codes = v, v + 1, v + 2
        order = {s: k for k, s in enumerate(sorted({self.scores[k] for k in self.ids.values()}, reverse=True))}
        self.rank = np.full(self.codes, -1, np.int64)
        self.left, self.right = np.arange(self.codes), np.arange(self.codes)
        usable, pairs = [], []
        for piece, k in self.ids.items():
            if len(piece) == 1 or self.kind == UNIGRAM:
                usable.append(piece)
                continue
            out, last = self.merges(piece)
            if len(out) == 1:
                usable.append(piece)
                self.left[k], self.right[k] = self.ids[last[0]], self.ids[last[1]]
                self.rank[k] = order[self.scores[k]]
                pairs.append((self.left[k] * self.codes + self.right[k], self.rank[k]))
        self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True)) if pairs else (np.empty(0, np.int64),) * 2
        hashes = np.array([self._hash(p) for p in usable], np.uint64)
        by = np.argsort(hashes)
        self.hashes, self.hashed_ids = hashes[by], np.array([self.ids[p] for p in usable], np.int64)[by]
        # Most substrings are no piece; a bit for the top of the hash spares the search.
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(hashes >> np.uint64(42)).astype(np.int64)] = True
        self.spelt = np.zeros((self.codes, self.longest), np.uint32)
        self.length = np.ones(self.codes, np.int64)
        for piece, k in self.ids.items():
            self.spelt[k, : len(piece)] = list(map(ord, piece))
            self.length[k] = len(piece)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces have the same hash")
        self.lengths = sorted({len(p) for p in usable} | {1})
        self.score = np.array([*self.scores, min(self.scores) - 10.0, 0.0])
        # Merges of equal score are ordered by place alone, which the pair test doesn't hold.
        tied = [k for k in self.ids.values() if self.rank[k] >= 0]
        ranks = self.rank[tied]
        shared = set(np.unique(ranks)[np.unique(ranks, return_counts=True)[1] > 1].tolist())
        self.tied = {c for k in tied if int(self.rank[k]) in shared for c in self.pieces[k]}
        if self.tied - {SPACE}:
            raise ValueError("pieces of equal score other than runs of spaces")

    @staticmethod
    def _hash(piece: str) -> int:
        value = 0
        for c in piece:
            value = (value * int(_PRIME) + ord(c) + 1) & (1 << 64) - 1
        return value

    def merges(self, unit: str) -> tuple[list[str], tuple[str, str] | None]:
        """BPE itself: the best pair first, the leftmost of equals. The pieces and the last merge."""
        parts: list[str | None] = list(unit)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts) and (k := self.ids.get(parts[a] + parts[b])) is not None:
                heapq.heappush(queue, (-self.scores[k], a, b, len(parts[a]) + len(parts[b])))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        last = None
        while queue:
            _, a, b, size = heapq.heappop(queue)
            if parts[a] is None or b >= len(parts) or parts[b] is None or after[a] != b or len(parts[a]) + len(parts[b]) != size:
                continue
            last = parts[a], parts[b]
            parts[a], parts[b] = parts[a] + parts[b], None
            after[a] = after[b]
            if after[b] < len(parts):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None], last

    def apart(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether BPE on each two pieces together leaves them apart.

        Walks back in time from both finished pieces. While the last piece of
        the first and the first piece of the second stand side by side, no
        merge of the two may come before the merge that ends this state.
        """
        good = np.ones(len(first), bool)
        live, r, t = np.arange(len(first)), first.copy(), second.copy()
        ends = np.full(len(first), np.iinfo(np.int64).max)
        while len(live):
            key = r * self.codes + t
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crossed = (self.pair_keys[at] == key) & (2 * self.pair_ranks[at] < ends)
            good[live[crossed]] = False
            rank_r, rank_t = self.rank[r], self.rank[t]
            go = ~crossed & ((rank_r >= 0) | (rank_t >= 0))
            live, r, t, rank_r, rank_t = live[go], r[go], t[go], rank_r[go], rank_t[go]
            back = rank_r > rank_t  # of equals the left was merged first
            ends = np.where(back, 2 * rank_r, 2 * rank_t + 1)
            r, t = np.where(back, self.right[r], r), np.where(back, t, self.left[t])
        return good

    def _probe(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each substring hash, or -1."""
        out = np.full(hashes.shape, -1, np.int64)
        row, at = np.nonzero(self.maybe[(hashes >> np.uint64(42)).astype(np.int64)])
        some = hashes[row, at]
        place = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
        out[row, at] = np.where(self.hashes[place] == some, self.hashed_ids[place], -1)
        return out

    def _lattice(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Paths of units of one length, one after another, and their lengths; `none` is a character that is no piece."""
        n, rows_n = len(units[0]), len(units)
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).reshape(rows_n, n)
        chars = points.astype(np.uint64) + np.uint64(1)
        lengths = [size for size in self.lengths if size <= n]
        found, rolled = {}, np.zeros((rows_n, n + 1), np.uint64)
        for size in range(1, lengths[-1] + 1):
            rolled = rolled[:, : n - size + 1] * _PRIME + chars[:, size - 1 :]
            if size in lengths:
                found[size] = self._probe(rolled)
        found[1] = np.where(found[1] < 0, self.none, found[1])
        last = np.full((n + 1, rows_n), self.edge)
        best, back = np.zeros((n + 1, rows_n)), np.zeros((n + 1, rows_n), np.int64)
        sizes, rows = np.array(lengths), np.arange(rows_n)
        for j in range(1, n + 1):
            step = np.stack([found[size][:, j - size] for size in lengths if size <= j])
            k, row = np.nonzero(step >= 0)
            piece, start = step[k, row], j - sizes[k]
            gain = np.full(step.shape, -np.inf)
            if self.kind == UNIGRAM:
                gain[k, row] = best[start, row] + self.score[piece]
            else:
                gain[k, row] = np.where(self.apart(last[start, row], piece), 0.0, -np.inf)
            chosen = gain.argmax(axis=0)
            best[j], back[j], last[j] = gain[chosen, rows], sizes[chosen], step[chosen, rows]
        path, at, steps = np.full((rows_n, n), -1), np.full(rows_n, n), np.zeros(rows_n, np.int64)
        while (on := np.flatnonzero(at > 0)).size:
            steps[on] += 1
            piece = last[at[on], on]
            path[on, n - steps[on]] = piece
            at[on] -= back[at[on], on]
            for i in range(self.longest):  # a path must spell its unit
                long = (self.length[piece] > i) & (piece != self.none)
                if not long.any():
                    break
                if (self.spelt[piece[long], i] != points[on[long], at[on[long]] + i]).any():
                    raise _Collision
        return path[path >= 0], steps

    def _as_bytes(self, unit: str, path: list[int]) -> list[int]:
        """The ids of a path, with unknown characters as bytes."""
        out: list[int] = []
        at = 0
        for k in path:
            if k == self.none:
                out += [self.byte_ids[b] for b in unit[at].encode()] if self.byte_fallback else [self.unknown]
            else:
                out.append(k)
            at += int(self.length[k])
        return out

    def _plain(self, unit: str) -> np.ndarray:
        """The path of one unit by its pieces themselves, without hashes."""
        if self.kind == BPE:
            return np.array([self.ids.get(p, self.none) for p in self.merges(unit)[0]], np.int64)
        best, back = [0.0] + [-np.inf] * len(unit), [(0, self.none)] * (len(unit) + 1)
        for j in range(1, len(unit) + 1):
            for size in (x for x in self.lengths if x <= j):
                piece = self.ids.get(unit[j - size : j], self.none if size == 1 else None)
                if piece is not None and best[j - size] + self.score[piece] > best[j]:
                    best[j], back[j] = best[j - size] + self.score[piece], (size, piece)
        path, at = [], len(unit)
        while at:
            size, piece = back[at]
            path.append(piece)
            at -= size
        return np.array(path[::-1], np.int64)

    def _paths(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _lattice; in the rare case of a collision only its unit goes the plain way."""
        try:
            return self._lattice(units)
        except _Collision:
            if len(units) == 1:
                path = self._plain(units[0])
                return path, np.array([len(path)])
            half = len(units) // 2
            (a, m), (b, n) = self._paths(units[:half]), self._paths(units[half:])
            return np.r_[a, b], np.r_[m, n]

    def encode_units(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct units in some order, their ids one after another, and the number of each."""
        order: list[str] = []
        flats, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def add(alike: list[str], flat: np.ndarray, count: np.ndarray) -> None:
            if (flat == self.none).any():
                parts = np.split(flat, np.cumsum(count)[:-1])
                made = [self._as_bytes(u, p.tolist()) if (p == self.none).any() else p.tolist() for u, p in zip(alike, parts, strict=True)]
                flat, count = np.array(list(chain.from_iterable(made)), np.int64), np.array(list(map(len, made)))
            order.extend(alike)
            flats.append(flat)
            counts.append(count)

        by_length: dict[int, list[str]] = {}
        for unit in units:
            if self.kind == BPE and (len(unit) > LONG_UNIT or SPACE * 2 in unit):
                path = self._plain(unit)
                add([unit], path, np.array([len(path)]))
            else:
                by_length.setdefault(len(unit), []).append(unit)
        for alike in by_length.values():
            for k in range(0, len(alike), 8192):
                add(alike[k : k + 8192], *self._paths(alike[k : k + 8192]))
        return order, np.concatenate(flats).astype(np.int32), np.concatenate(counts)

    def units(self, text: str) -> list[str]:
        """Cuts before spaces, around line feeds, and where letters begin and end."""
        if not text:
            return []
        return self.cut.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


class Encoder:
    """Encodes batches of texts and remembers units: forgets them all once there are over REMEMBERED."""

    def __init__(self, pieces: Pieces):
        if any("\n" in p for p in pieces.ids):
            raise ValueError("line feeds are part of pieces: units can't be cut there")
        self.pieces = pieces
        self._forget()

    def _forget(self) -> None:
        #: Unit to its number, given when it is first asked for.
        self.place: defaultdict[str, int] = defaultdict(count().__next__)
        self.flat, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self) -> None:
        """Encode the units that have a number but no ids yet."""
        new = list(islice(self.place, len(self.counts), None))
        units, flat, counts = self.pieces.encode_units(new)
        at = np.fromiter(map(self.place.__getitem__, units), np.int64, len(units)) - len(self.counts)
        starts, sizes = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        starts[at], sizes[at] = len(self.flat) + np.cumsum(counts) - counts, counts
        self.flat = np.concatenate([self.flat, flat])
        self.starts, self.counts = np.concatenate([self.starts, starts]), np.concatenate([self.counts, sizes])

    def stream(self, texts: list[str | None]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Parts of the texts with their ids one after another and the number of each; a null text has none."""
        if len(self.place) > REMEMBERED:
            self._forget()
        at: list[np.ndarray] = []
        for text in texts:
            units = self.pieces.units(text) if text else []
            at.append(np.fromiter(map(self.place.__getitem__, units), np.int32, len(units)))
        self._learn()
        first = 0
        while first < len(texts):
            last, units = first + 1, len(at[first])
            while last < len(texts) and units + len(at[last]) <= PART_UNITS:
                units, last = units + len(at[last]), last + 1
            here = np.concatenate(at[first:last])
            many = self.counts[here]
            ends = np.r_[0, np.cumsum(many)]
            ids = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[here] - ends[:-1], many)]
            yield slice(first, last), ids, np.diff(ends[np.r_[0, np.cumsum([len(x) for x in at[first:last]])]])
            first = last

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of each."""
        parts = list(self.stream(texts))
        return np.concatenate([np.empty(0, np.int32), *(p[1] for p in parts)]), np.concatenate([np.empty(0, np.int64), *(p[2] for p in parts)])


def spelt(pieces: Pieces, ids: np.ndarray, sizes: np.ndarray) -> tuple[bytes, list[int]]:
    """The bytes of all texts one after another and where each ends, from 0; `sizes` counts the ids of each."""
    width = pieces.surface_width[ids]
    ends = np.r_[0, np.cumsum(width)]
    text = pieces.surface_bytes[np.arange(ends[-1]) + np.repeat(pieces.surface_start[ids] - ends[1:] + width, width)].tobytes()
    return text, ends[np.r_[0, np.cumsum(sizes)]].tolist()


def restored(pieces: Pieces, texts: list[str | None], ids: np.ndarray, sizes: np.ndarray) -> list[bool]:
    """Whether decoding the ids of each text gives its bytes; all ids are decoded at once."""
    text, bounds = spelt(pieces, ids, sizes)
    skip = int(pieces.prefix)
    return [t is None or text[a + (skip if t else 0) : b] == t.encode() for t, a, b in zip(texts, bounds, bounds[1:], strict=False)]


def encode_documents(docs: DataFrame, model: str = MODEL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, restored) for every row; restored: decoding the ids gives the whole text.

    The broadcast tables are bounded by the model's vocabulary.
    """
    spark = docs.sparkSession
    small_batches(spark, 1200)
    shared = spark.sparkContext.broadcast(Pieces(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part, ids, counts in encoder.stream(texts):
                some = texts[part]
                same = restored(encoder.pieces, some, ids, counts)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids), mask=pa.array([t is None for t in some], pa.bool_()))
                own = batch.column(0).slice(part.start, len(some))
                yield pa.RecordBatch.from_arrays([own, lists, pa.array(counts, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_tokens", "restored"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(named(doc_id), named(text)).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long, restored boolean")


def decode_documents(encoded: DataFrame, model: str = MODEL, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) for every row; null ids give a null text, a null among a row's ids spells nothing."""
    small_batches(encoded.sparkSession, 1200)
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in batches:
            lists = batch.column(1)
            flat, rows = lists.flatten(), pc.list_parent_indices(lists)
            rows, flat = rows.filter(flat.is_valid()).to_numpy(), flat.drop_null().to_numpy()
            text, bounds = spelt(pieces, flat, np.bincount(rows, minlength=len(lists)))
            starts = [a + (pieces.prefix and text[a : min(a + 1, b)] == b" ") for a, b in zip(bounds, bounds[1:], strict=False)]
            texts = [text[a:b].decode("utf-8", "replace") if given else None for a, b, given in zip(starts, bounds[1:], lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema[doc_id].dataType.simpleString()
    return encoded.select(doc_id, ids).mapInArrow(run, f"doc_id {kind}, text string")
