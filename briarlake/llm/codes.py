"""Vector code compression: product codes by an exact Lloyd iteration whose parts wait in heaps.

Vectors become whole numbers and are cut into equal parts; each part position has
a codebook, first the parts of the smallest ids. A round assigns every part to
its nearest entry, then moves entries to the floor of their parts' mean.

Heap Lloyd: when a part is assigned exactly, its distance to its entry (upper)
and to the next nearest (lower) are known. As entries move, upper grows by its
entry's drift at most and lower falls by the largest drift of the others. Every
block of rows keeps, for each position and entry, a heap of its parts by the slack
lower - upper plus the drift its entry had gathered by then; a part whose key is
above the drift gathered since can't have changed its entry. A round pops only
the keys that drift has reached and scans those parts against all entries. A heap
is an ascending array: popping takes its front, found by binary search; it is
stored with its block, so no round sorts anew what stays. Equal distances count
as reached, since the lower index wins ties; rounding is on the safe side.

Only sums per entry (or their changes) leave a block; they add up in Spark and
codebooks alone reach the driver: positions x entries x part length numbers.
State is written once a round, the round before is dropped, and a lost executor
repeats its blocks of one round.

Defined results: rows whose vector is null or has null or non-finite parts go.
Shorter vectors, and lengths that don't divide, end in zeros. Ids may be null or
repeat: nulls come last and equal ids in order of their vectors when codebooks
start; every row has its own result. Fewer rows than entries make shorter
codebooks. Empty vectors have code 0 and error 0. An empty table has no rows.
Labels that are null count as equal. Columns beside the three are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briarlake.llm.text import small_batches
from briarlake.llm.vectors import blocked, longs, matrix, numbers, whole
from briarlake.scratch import Scratch


@dataclass(frozen=True)
class Codes:
    """Positions, entries (256 at most) and rounds of a code; `block` rows (65,536 at most) share their heaps."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    block: int = 4096


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to the entries."""
    x, book = numbers(x, book)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)[None, :]


def _scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x, its nearest entry (of equals the first) and its slack, rounded down."""
    squares = _squares(x, book)
    best, rows = squares.argmin(axis=1), np.arange(len(x))
    upper = np.sqrt(squares[rows, best].astype(np.float64))
    if len(book) == 1:
        return best, np.full(len(x), np.inf)
    squares[rows, best] = squares.max() + 1
    lower = np.sqrt(squares.min(axis=1).astype(np.float64))
    return best, lower - upper - 1e-9 * (lower + upper)


class _Heaps:
    """The heaps of one block: at each position, rows and keys entry by entry, ascending by key, and where each entry starts."""

    def __init__(self, rows: np.ndarray, keys: np.ndarray, starts: np.ndarray):
        self.rows, self.keys, self.starts = rows, keys, starts

    @classmethod
    def empty(cls, n: int, parts: int, entries: int) -> _Heaps:
        return cls(np.zeros((parts, n), np.uint16), np.zeros((parts, n), np.float32), np.zeros((parts, entries + 1), np.int32))

    @classmethod
    def read(cls, data: tuple[bytes, bytes, bytes], parts: int) -> _Heaps:
        kinds = (np.uint16, np.float32, np.int32)
        return cls(*(np.frombuffer(d, k).reshape(parts, -1).copy() for d, k in zip(data, kinds, strict=True)))

    def data(self) -> tuple[bytes, bytes, bytes]:
        return self.rows.tobytes(), self.keys.tobytes(), self.starts.tobytes()

    def codes(self) -> np.ndarray:
        """Rows x positions."""
        parts, n = self.rows.shape
        out, entries = np.empty((n, parts), np.int64), np.arange(self.starts.shape[1] - 1)
        for p in range(parts):
            out[self.rows[p], p] = np.repeat(entries, np.diff(self.starts[p]))
        return out

    def popped(self, p: int, drift: np.ndarray) -> np.ndarray:
        """Places at position p of the keys that their entry's drift has reached: the front of each heap."""
        starts, keys = self.starts[p], self.keys[p]
        fronts = [s + np.arange(np.searchsorted(keys[s:e], d, "right")) for s, e, d in zip(starts[:-1], starts[1:], drift, strict=True) if d > 0 and s < e]
        return np.concatenate(fronts) if fronts else np.empty(0, int)

    def push(self, p: int, places: np.ndarray | None, rows: np.ndarray, entry: np.ndarray, keys: np.ndarray) -> None:
        """Put rows into the heaps of their entries, in place of those at `places`."""
        starts = self.starts[p]
        stay = np.ones(len(self.rows[p]), bool) if places is not None else np.zeros(len(self.rows[p]), bool)
        if places is not None:
            stay[places] = False
        keys = np.nextafter(keys.astype(np.float32), np.float32(-np.inf))
        old = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[stay] if places is not None else np.empty(0, int)
        at, key, row = np.r_[old, entry], np.r_[self.keys[p][stay], keys], np.r_[self.rows[p][stay], rows.astype(np.uint16)]
        order = np.lexsort((key, at))
        self.rows[p], self.keys[p] = row[order], key[order]
        self.starts[p] = np.searchsorted(at[order], np.arange(len(starts)))


def _changes(x: np.ndarray, before: np.ndarray | None, after: np.ndarray, entries: int) -> bytes:
    """Change of (count, sums) of each position and entry; x is rows x positions x part length."""
    n, parts, size = x.shape
    out = np.zeros((parts, entries, 1 + size), np.int64)
    counted = np.concatenate([np.ones((n, parts, 1), np.int64), x], axis=2)
    for p in range(parts):
        moved = np.arange(n) if before is None else np.flatnonzero(before[:, p] != after[:, p])
        np.add.at(out[p], after[moved, p], counted[moved, p])
        if before is not None:
            np.subtract.at(out[p], before[moved, p], counted[moved, p])
    return out.tobytes()


_STATE = ["ids", "labels", "vectors", "rows", "keys", "starts", "changes"]


def _started(books: np.ndarray, how: Codes):
    """(vec_id, label, whole) to blocks with their heaps after a scan of everything."""
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocked(batches, how.block):
            flat = matrix(batch.column(2), parts * size)
            x, heaps = flat.reshape(len(flat), parts, size), _Heaps.empty(len(flat), parts, entries)
            for p in range(parts):
                entry, slack = _scan(x[:, p], books[p])
                heaps.push(p, None, np.arange(len(flat)), entry, slack)
            one = lambda column: pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), column)
            binary = [pa.array([d], pa.binary()) for d in (flat.astype(np.int32).tobytes(), *heaps.data(), _changes(x, None, heaps.codes(), entries))]
            yield pa.RecordBatch.from_arrays([one(batch.column(0)), one(batch.column(1)), *binary], names=_STATE)

    return run


def _moved(books: np.ndarray, drift: np.ndarray, last: bool, id_kind: pa.DataType | None = None):
    """Blocks after popping what `drift` has reached; if `last`, (vec_id, label, code, error) of their rows."""
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                data = [row.column(n)[0].as_buffer().to_pybytes() for n in ("vectors", "rows", "keys", "starts")]
                flat, heaps = np.frombuffer(data[0], np.int32).astype(np.int64), _Heaps.read(tuple(data[1:]), parts)
                x = flat.reshape(heaps.rows.shape[1], parts, size)
                before = heaps.codes()
                for p in range(parts):
                    places = heaps.popped(p, drift[p])
                    if len(places):
                        rows = heaps.rows[p][places].astype(int)
                        entry, slack = _scan(x[rows, p], books[p])
                        heaps.push(p, places, rows, entry, slack + drift[p][entry])
                after = heaps.codes()
                if last:
                    gap, own = numbers(x, np.stack([books[p][after[:, p]] for p in range(parts)], axis=1))
                    error = longs(((gap - own) ** 2).reshape(len(x), -1).sum(axis=1))
                    code = [c.tobytes().hex() for c in after.astype(np.uint8)]
                    yield pa.RecordBatch.from_arrays([row.column(0).flatten(), row.column(1).flatten(), pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])
                else:
                    binary = [pa.array([d], pa.binary()) for d in (*heaps.data(), _changes(x, before, after, entries))]
                    yield pa.RecordBatch.from_arrays([*row.columns[:3], *binary], names=_STATE)

    return run


def _totals(parts: int, entries: int, size: int):
    """The changes of a task's blocks, added up: (place, change) of those that aren't 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(parts * entries * (1 + size), np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += np.frombuffer(data.as_buffer(), np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["place", "change"])

    return run


def _gather(state: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """Positions x entries x (count, sums) of all blocks."""
    parts, entries, size = shape
    out = np.zeros(parts * entries * (1 + size), np.int64)
    for r in state.select("changes").mapInArrow(_totals(*shape), "place long, change long").groupBy("place").agg(F.sum("change").alias("change")).collect():
        out[r.place] = r.change
    return out.reshape(parts, entries, 1 + size)


def _drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Positions x entries: by how much an entry's own move and the largest of the others can shrink a slack, rounded up."""
    moves = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=2))
    if moves.shape[1] == 1:
        return moves
    top = np.sort(moves, axis=1)[:, -2:]
    others = np.where(moves == top[:, 1:], top[:, :1], top[:, 1:])
    others = np.where((moves == top[:, 1:]).sum(axis=1, keepdims=True) > 1, top[:, 1:], others)
    return (moves + others) * (1 + 1e-6)


def compressed(embeddings: DataFrame, scratch: Scratch, how: Codes = Codes(), vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every usable row, and the codebooks: positions x entries x part length."""
    small_batches(embeddings.sparkSession)
    rows = whole(embeddings, vec_id, vector, label, how.scale)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    width = rows.agg(F.max(F.size("whole"))).first()[0] or 0
    size = max(1, -(-width // how.parts))
    first = [r.whole for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "whole").select("vec_id", "whole").limit(how.entries).collect()]
    result = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    if not first:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.empty((how.parts, 0, size), np.int64)
    start = matrix(pa.array(first, pa.list_(pa.int32())), how.parts * size)
    books = start.reshape(len(first), how.parts, size).transpose(1, 0, 2).copy()
    schema = f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, vectors binary, rows binary, keys binary, starts binary, changes binary"
    state = scratch.keep(rows.mapInArrow(_started(books, how), schema))
    sums, drift = np.zeros((*books.shape[:2], 1 + size), np.int64), np.zeros(books.shape[:2])
    for k in range(how.rounds):
        sums += _gather(state, books.shape)
        counts = sums[:, :, :1]
        new = np.where(counts > 0, sums[:, :, 1:] // np.maximum(counts, 1), books)
        drift, books = drift + _drifts(books, new), new
        if k < how.rounds - 1:
            after = scratch.keep(state.mapInArrow(_moved(books, drift, False), schema))
            scratch.drop(state)
            state = after
    found = scratch.keep(state.mapInArrow(_moved(books, drift, True), result))
    scratch.drop(state)
    return found, books


def fingerprint(books: np.ndarray) -> str:
    """SHA-256 of all whole numbers by position, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest() if books.size else hashlib.sha256(b"").hexdigest()


def digest(found: DataFrame, books: np.ndarray, scratch: Scratch) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256)."""
    totals = scratch.keep(found.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    joined = found.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """Assignment k and, after it, codebook k + 1."""
    return f"""a{k} AS MATERIALIZED (SELECT row, part, arg_min(entry, (gap, entry)) AS entry, min(gap) AS gap FROM (SELECT p.row, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS gap FROM p JOIN b{k} b USING (part)) GROUP BY row, part),
 m{k} AS (SELECT part, entry, list(mean ORDER BY place) AS x FROM (SELECT part, entry, place, CAST(floor(sum(v) / count(*)::DOUBLE) AS BIGINT) AS mean FROM (SELECT a.part, a.entry, unnest(p.x) AS v, unnest(range(len(p.x))) AS place FROM a{k} a JOIN p USING (row, part)) GROUP BY part, entry, place) GROUP BY part, entry),
 b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"""


SQL = f"""WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS MATERIALIZED (SELECT row, part, list_slice(x, part * (len(x) // 16) + 1, (part + 1) * (len(x) // 16)) AS x FROM e, range(16) r(part)), b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x FROM p WHERE row <= 64),
 {_round_sql(0)}, {_round_sql(1)}, a2 AS MATERIALIZED (SELECT row, part, arg_min(entry, (gap, entry)) AS entry, min(gap) AS gap FROM (SELECT p.row, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS gap FROM p JOIN b2 b USING (part)) GROUP BY row, part),
 c AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(gap) AS BIGINT) AS error FROM a2 GROUP BY row), s AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) AS h FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS place FROM b2))
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM e JOIN c USING (row), s"""
