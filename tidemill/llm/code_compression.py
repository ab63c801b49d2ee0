"""Product codes of vectors: Lloyd rounds that rescan only the parts which codebook drift may have moved."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete, materialize, skewed_join, written

#: Vectors of a block: a row of the table that is carried from round to round.
BLOCK = 1 << 13
#: Relative slack of bounds against rounding of square roots and sums; a part within it is rescanned.
SLACK = 1e-9
#: A block with its heaps, and, in a task's last block, what the entries' counts and sums gained in the last round.
STATE = (
    "vec_id array<long>, label array<{}>, values binary, codes binary, keys binary, rows binary, sizes array<int>,"
    " moved array<struct<part:int,entry:int,n:long,sums:array<decimal(38,0)>>>"
)
MOVED = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))]))


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(vec_id, v, label) of the rows whose vector holds neither nulls nor non-finite components; v is floor(scale * x)."""
    v = F.col(vector_col)
    good = v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return vectors.where(good).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"), F.col(label_col).alias("label")
    )


def _most(*of: np.ndarray) -> int:
    """The largest absolute component, at least."""
    return max(max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) for x in of)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` and ``b`` (integers): by floats where they are exact, by Python's integers for huge components."""
    if a.shape[1] * (2 * _most(a, b)) ** 2 < 1 << 52:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None]).astype(np.int64)
    x, y = a.astype(object), b.astype(object)
    return np.array([[((p - q) ** 2).sum() for q in y] for p in x], dtype=object).reshape(len(x), len(y))


class Heaps:
    """The parts at one position of a block: an entry's heap holds its parts, least slack first.

    A part's slack is its distance to the nearest other entry less that to its own; its key is the slack plus the drift
    that its entry had gathered before. Once gathered drift reaches the key, another entry may be as near, and the part is scanned again.
    """

    def __init__(self, codes: np.ndarray, heaps: list[list[tuple[float, int]]]) -> None:
        self.codes, self.heaps = codes, heaps

    @classmethod
    def empty(cls, n: int, entries: int) -> Heaps:
        return cls(np.full(n, -1, np.int64), [[] for _ in range(entries)])

    def scan(self, rows: np.ndarray, values: np.ndarray, book: np.ndarray, drift: np.ndarray) -> None:
        """Give ``rows`` their nearest entry (ties to the lower index) and put them on its heap."""
        for at in range(0, len(rows), 4096):
            some = rows[at : at + 4096]
            squared = squared_distances(values[some], book)
            code = squared.argmin(1)
            own = np.sqrt(squared[np.arange(len(some)), code].astype(np.float64))
            if len(book) > 1:
                squared[np.arange(len(some)), code] = squared.max() + 1 if squared.size else 0
                slack = np.sqrt(squared.min(1).astype(np.float64)) * (1 - SLACK) - own * (1 + SLACK)
            else:
                slack = np.full(len(some), np.inf)
            self.codes[some] = code
            for row, entry, key in zip(some.tolist(), code.tolist(), (slack + drift[code]).tolist(), strict=True):
                heapq.heappush(self.heaps[entry], (key, row))

    def pop(self, drift: np.ndarray) -> np.ndarray:
        """The parts whose key gathered drift has reached, taken off their heaps."""
        found = []
        for heap, gathered in zip(self.heaps, drift.tolist(), strict=True):
            while heap and heap[0][0] <= gathered:
                found.append(heapq.heappop(heap)[1])
        return np.array(sorted(found), np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Integers in the narrowest of 2, 4 or 8 bytes, told by the length."""
    most = max(-int(values.min(initial=0)) - 1, int(values.max(initial=0)))
    return values.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64).tobytes()


def _unpacked(raw: bytes, n: int, dims: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(raw) // max(1, n * dims)] if n * dims else np.int16
    return np.frombuffer(raw, kind).reshape(n, dims)


def _sums(moves: dict, part: int, codes: np.ndarray, values: np.ndarray, sign: int) -> None:
    for entry in np.unique(codes[codes >= 0]).tolist():
        inside = values[codes == entry]
        n, sums = moves.get((part, entry), (0, 0))
        wide = inside.astype(object if _most(inside) > 1 << 40 else np.int64)
        moves[part, entry] = n + sign * len(inside), sums + sign * wide.sum(0).astype(object)


class Block:
    """Vectors of a task with the heaps of each part position, as a row of the carried table."""

    def __init__(self, ids: pa.Array, labels: pa.Array, values: np.ndarray, parts: list[Heaps]) -> None:
        self.ids, self.labels, self.values, self.parts = ids, labels, values, parts

    @classmethod
    def of_row(cls, row: pa.RecordBatch, dims: int, n_parts: int, entries: int) -> Block:
        at = {c: row[c][0] for c in row.schema.names}
        ids, labels = at["vec_id"].values, at["label"].values
        n = len(ids)
        codes = np.frombuffer(at["codes"].as_py(), np.int16).reshape(n_parts, n).astype(np.int64)
        keys, rows = np.frombuffer(at["keys"].as_py()).tolist(), np.frombuffer(at["rows"].as_py(), np.int32).tolist()
        heaps, start = [], 0
        for size in at["sizes"].as_py():
            heaps.append(list(zip(keys[start : start + size], rows[start : start + size], strict=True)))
            start += size
        parts = [Heaps(codes[p], heaps[p * entries : (p + 1) * entries]) for p in range(n_parts)]
        return cls(ids, labels, _unpacked(at["values"].as_py(), n, dims), parts)

    def part(self, p: int) -> np.ndarray:
        width = self.values.shape[1] // len(self.parts)
        return self.values[:, p * width : (p + 1) * width]

    def advance(self, books: list[np.ndarray], drift: np.ndarray, moves: dict) -> None:
        """Scan the parts that drift may have moved; ``moves`` takes what counts and sums of entries gain and lose."""
        for p, (heaps, book) in enumerate(zip(self.parts, books, strict=True)):
            fresh = heaps.codes[:1].tolist() == [-1]
            rows = np.arange(len(self.ids)) if fresh else heaps.pop(drift[p])
            before = heaps.codes[rows].copy()
            values = self.part(p)
            heaps.scan(rows, values, book, drift[p])
            changed = rows[heaps.codes[rows] != before]
            _sums(moves, p, before[heaps.codes[rows] != before], values[changed], -1)
            _sums(moves, p, heaps.codes[changed], values[changed], 1)

    def row(self, moves: dict) -> pa.RecordBatch:
        heaps = [heap for part in self.parts for heap in part.heaps]
        whole = pa.array([0, len(self.ids)], pa.int32())
        moved = [{"part": p, "entry": e, "n": n, "sums": [int(x) for x in sums]} for (p, e), (n, sums) in sorted(moves.items())]
        packed = {
            "values": _packed(self.values),
            "codes": np.array([part.codes for part in self.parts]).astype(np.int16).tobytes(),
            "keys": np.array([key for heap in heaps for key, _ in heap], np.float64).tobytes(),
            "rows": np.array([row for heap in heaps for _, row in heap], np.int32).tobytes(),
        }
        columns = {
            "vec_id": pa.ListArray.from_arrays(whole, self.ids),
            "label": pa.ListArray.from_arrays(whole, self.labels),
            **{c: pa.array([x], pa.binary()) for c, x in packed.items()},
            "sizes": pa.array([[len(heap) for heap in heaps]], pa.list_(pa.int32())),
            "moved": pa.array([moved], MOVED),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How much nearer, at most, another entry came to what an entry holds: its own way and the longest way of the others."""
    way = np.array([float(sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True))) for x, y in zip(old, new, strict=True)]) ** 0.5
    order = np.sort(way)
    others = np.where(way == order[-1], order[-2] if len(order) > 1 else 0.0, order[-1])
    return (way + others) * (1 + SLACK)


def compress_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    n_parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
) -> DataFrame:
    """One row (vec_id, code, error, label_error, codebooks_sha256) for each kept row of ``vectors``.

    Rows whose vector is null or holds null or non-finite components are dropped. Components become floor(scale * x), within
    a long; vectors are cut into ``n_parts`` equal parts. The codebook of a position starts as that part of the
    ``entries`` smallest ids, ascending (null ids last, ties by vector); fewer rows give fewer entries.
    ``rounds`` times each part takes the nearest entry (squared distance, ties to the lower index) and each used entry
    becomes floor(sum / count) of its parts; then parts take the nearest entry again. Errors beyond a long are held
    at its greatest value. Equal labels, null ones together, share their error's sum. Repeated rows are rows of their own. Vectors of
    another length than the first id's, or of one that ``n_parts`` does not divide, are a ValueError. Columns that are not named are
    ignored. An empty table gives an empty result.

    Distances are exact integers. Vectors live in blocks, with a heap for each entry and position; a round reads the
    blocks where they are, scans only parts that the entries' gathered drift has reached, and writes the blocks
    again with what the entries' sums gained and lost: no vector is shuffled, a lost executor repeats a round's tasks alone, and
    the driver holds the codebooks and their sums only.
    """
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, id_col, vector_col, label_col, scale)
    label_type = kept.schema["label"].dataType.simpleString()
    out = f"vec_id long, label {label_type}, code string, error decimal(38,0)"
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    dims = len(first[0]["v"]) if first else 0
    if dims % n_parts:
        raise ValueError(f"vectors of {dims} components cannot be cut into {n_parts} parts")
    if not first:
        none = spark.createDataFrame([], out).withColumn("error", F.col("error").cast("long"))
        return none.select("vec_id", "code", "error", F.lit(None).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    whole, width = np.array([r["v"] for r in first if len(r["v"]) == dims], np.int64), dims // n_parts
    books = [whole[:, p * width : (p + 1) * width].copy() for p in range(n_parts)]
    drift = np.zeros((n_parts, len(whole)))
    totals = [[0, [0] * width] for _ in range(n_parts * len(whole))]
    schema = STATE.format(label_type)
    blocks, path = kept, None
    for _ in range(rounds):
        step = (_first_step if path is None else _next_step)(dims, n_parts, books, drift)
        made = written(blocks.mapInArrow(step, schema), "codes")
        if path:
            delete(spark, path)
        blocks, path = spark.read.schema(schema).parquet(made), made
        moved = (
            blocks.select(F.explode("moved").alias("m"))
            .select("m.part", "m.entry", "m.n", F.posexplode_outer("m.sums").alias("at", "sum"))
            .groupBy("part", "entry", "at")
            .agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
        )
        for r in moved.collect():  # entries times dimensions, whatever the table
            total = totals[r["part"] * len(whole) + r["entry"]]
            if r["at"] in (None, 0):
                total[0] += r["n"]
            if r["at"] is not None:
                total[1][r["at"]] += int(r["sum"])
        for p in range(n_parts):
            new = books[p].copy()
            for e in range(len(whole)):
                n, sums = totals[p * len(whole) + e]
                if n:
                    new[e] = [s // n for s in sums]
            drift[p] += _drifts(books[p], new)
            books[p] = new
    digest = hashlib.sha256(",".join(str(x) for book in books for x in book.reshape(-1).tolist()).encode()).hexdigest()
    done = materialize(blocks.mapInArrow(_last_step(dims, n_parts, books, drift, path is None), out), "codes-done")
    if path:
        delete(spark, path)
    return _with_label_errors(done).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _as_long(sum_: Column) -> Column:
    return F.least(sum_, F.lit((1 << 63) - 1)).cast("long")


def _with_label_errors(done: DataFrame) -> DataFrame:
    """``error`` and ``label_error`` as longs; rows of a hot label are joined where they are."""
    done = done.withColumn("key", F.struct(F.col("label").isNull(), "label"))
    sums = materialize(done.groupBy("key").agg(F.sum("error").alias("total"), F.count(F.lit(1)).alias("n")), "code-labels")
    joined = skewed_join(done, sums, ["key"], "n")
    return joined.select("vec_id", "code", _as_long(F.col("error")).alias("error"), _as_long(F.col("total")).alias("label_error"))


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, n_parts: int, entries: int) -> Iterator[Block]:
    """New blocks of the rows that a task reads."""
    held, n = [], 0

    def block() -> Block:
        rows = pa.Table.from_batches(held)
        vectors = rows["v"].combine_chunks()
        if (np.diff(vectors.offsets.to_numpy()) != dims).any():
            raise ValueError(f"a vector has not the {dims} components of the first")
        values = vectors.flatten().to_numpy().reshape(rows.num_rows, dims)
        parts = [Heaps.empty(rows.num_rows, entries) for _ in range(n_parts)]
        return Block(rows["vec_id"].combine_chunks(), rows["label"].combine_chunks(), values, parts)

    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            held.append(batch.slice(at, BLOCK))
            n += held[-1].num_rows
            if n >= BLOCK:
                yield block()
                held, n = [], 0
    if n:
        yield block()


def _kept_blocks(batches: Iterator[pa.RecordBatch], dims: int, n_parts: int, entries: int) -> Iterator[Block]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield Block.of_row(batch.slice(at, 1), dims, n_parts, entries)


def _carried(blocks: Iterator[Block], books: list[np.ndarray], drift: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks after a round; the last one of a task bears what the whole task moved, so that it is a row for each entry and task."""
    moves, held = {}, None
    for block in blocks:
        if held is not None:
            yield held.row({})
        block.advance(books, drift, moves)
        held = block
    if held is not None:
        yield held.row(moves)


def _first_step(dims: int, n_parts: int, books: list[np.ndarray], drift: np.ndarray):
    return lambda batches: _carried(_blocks(batches, dims, n_parts, len(books[0])), books, drift)


def _next_step(dims: int, n_parts: int, books: list[np.ndarray], drift: np.ndarray):
    return lambda batches: _carried(_kept_blocks(batches, dims, n_parts, len(books[0])), books, drift)


def _last_step(dims: int, n_parts: int, books: list[np.ndarray], drift: np.ndarray, fresh: bool):
    """Codes and exact errors after the last assignment."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (_blocks if fresh else _kept_blocks)(batches, dims, n_parts, len(books[0])):
            block.advance(books, drift, {})
            n = len(block.ids)
            error, code = np.zeros(n, object), np.zeros(n, "U1")
            wide = dims * (2 * _most(block.values, *books)) ** 2 >= 1 << 62
            for p, (heaps, book) in enumerate(zip(block.parts, books, strict=True)):
                kind = object if wide else np.int64
                apart = block.part(p).astype(kind) - book[heaps.codes].astype(kind)
                error = error + (apart * apart).sum(1)
                code = np.char.add(code, np.array([f"{c:02x}" for c in heaps.codes.tolist()]))
            yield pa.RecordBatch.from_arrays(
                [
                    block.ids,
                    block.labels,
                    pa.array(code.tolist(), pa.string()),
                    pa.array([int(x) for x in error], pa.decimal128(38, 0)),
                ],
                ["vec_id", "label", "code", "error"],
            )

    return step
