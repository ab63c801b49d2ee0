"""How filters of documents interact: exact copies by routed fingerprints, and counts of every combination of failures."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import count, permutations, repeat

import numpy as np
from pyspark.rdd import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_of

#: Bytes of texts that a map task holds before it passes its chains on, and about those of a routed partition.
LOCAL_BYTES, ROUTED_BYTES = 32 << 20, 32 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long,"
    " good_lost long, toxic_lost long, shapley long"
)


def quality_filters(text_col: str = "text") -> dict[str, Column]:
    """When a text fails: A under 200 words, B under half of them distinct, C over 3% capitals, D holds any of #$%&*|."""
    text = text_of(text_col)
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, distinct, chars = F.size(words), F.size(F.array_distinct(words)), F.length(text)
    return {
        "A": n < 200,
        "B": 100 * distinct < 50 * n,
        "C": 100 * (chars - F.length(F.translate(text, UPPER, ""))) > 3 * chars,
        "D": text.rlike(r"[#$%&*|]"),
    }


class _Chains:
    """Texts by fingerprint. Of each text the smallest id, and what its rows with that id carry, counted."""

    def __init__(self) -> None:
        self.of: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, print_: int, text: bytes, id_: int, carried: dict) -> Iterator[tuple[int, dict]]:
        """Put rows in; gives those that now are known to have a smaller one, with their id."""
        chain = self.of.setdefault(print_, [])
        for entry in chain:
            if entry[0] == text:
                if id_ > entry[1]:
                    yield id_, carried
                elif id_ < entry[1]:
                    yield entry[1], entry[2]
                    entry[1:] = id_, carried
                else:
                    for cell, n in carried.items():
                        entry[2][cell] = entry[2].get(cell, 0) + n
                return
        chain.append([text, id_, carried])
        self.bytes += len(text) + 200

    def entries(self) -> Iterator[tuple[int, tuple]]:
        return ((print_, (*entry, False)) for print_, chain in self.of.items() for entry in chain)


def route_copies(rows: RDD, partitions: int) -> RDD:
    """Rows (fingerprint, text, id, carried) as (id, carried, copy), where ``copy`` tells that a row of the same text has a smaller id.

    Each map task chains its own rows first, so that of a group of copies one entry leaves a task for each
    LOCAL_BYTES of texts that it reads, however many copies there are; what is known to be a copy goes on without its text.
    Entries are then partitioned by fingerprint; texts of one fingerprint are told apart in full. A null id is neither
    smaller nor larger than any. ``carried`` must be hashable.
    """

    def local(part: Iterable) -> Iterator:
        chains, spread = _Chains(), count()
        for print_, text, id_, carried in part:
            if id_ is None:
                yield next(spread), (None, None, {carried: 1}, False)
                continue
            for other, cells in chains.add(print_, text, id_, {carried: 1}):
                yield next(spread), (None, other, cells, True)
            if chains.bytes > LOCAL_BYTES:
                yield from chains.entries()
                chains = _Chains()
        yield from chains.entries()

    def meet(part: Iterable) -> Iterator:
        chains = _Chains()
        for print_, (text, id_, cells, copy) in part:
            done = [(id_, cells, copy)] if text is None else [(*x, True) for x in chains.add(print_, text, id_, cells)]
            for other, known, so in done:
                for cell, n in known.items():
                    yield from repeat((other, cell, so), n)
        for _, (_, id_, cells, _) in chains.entries():
            for cell, n in cells.items():
                yield from repeat((id_, cell, False), n)

    return rows.mapPartitions(local).partitionBy(partitions, int).mapPartitions(meet)


def failure_masks(docs: DataFrame, filters: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row (id long, part, mask) for each row of ``docs``: bit k of the mask for the k-th filter, the last bit for exact copies.

    A row is a copy if any row of the whole table with the same text (null: empty) has a smaller id. A null part is the empty string.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0))
    rows = docs.select(
        F.xxhash64(text), text.cast("binary"), F.col(id_col).cast("long"), F.coalesce(F.col(part_col).cast("string"), F.lit("")), mask.cast("int")
    )
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    partitions = max(spark.sparkContext.defaultParallelism, -(-size // ROUTED_BYTES))
    copy_bit = 1 << len(filters)
    routed = route_copies(rows.rdd.map(lambda r: (r[0], bytes(r[1]), r[2], (r[3], r[4]))), partitions)
    return spark.createDataFrame(routed.map(lambda x: (x[0], x[1][0], x[1][1] | (copy_bit if x[2] else 0))), "id long, part string, mask int")


def filter_audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: dict[str, Column] | None = None,
    copies: str = "E",
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """What each filter removes in each order of all filters: for each part, order and step a row (see AUDIT).

    ``filters`` (by default ``quality_filters``) are conditions under which a row fails, by letter; ``copies`` is the
    letter of the filter that fails rows whose text (null: empty) a row with a smaller id has, anywhere in the table, removed
    or not. A condition that is null does not fail. Of ``labels`` (doc_id, quality, toxic) any row of an id that says 1 counts; ids
    without labels, and null ids, are neither good nor toxic. Each row of ``docs`` counts, repeated ones too: rows that share the
    smallest id of their text are no copies; a null id is neither smaller nor larger than any. A null
    part counts as the empty string. Only parts of rows that exist have rows; an empty table gives an empty result. Other columns are ignored.

    Texts move once, to find the copies (``route_copies``). Rows of an id are counted by mask before the labels are
    joined, and counts by mask are combined in each task before they meet, as one vector for each part.
    """
    spark = docs.sparkSession
    filters = quality_filters(text_col) if filters is None else filters
    letters = [*filters, copies]
    n_masks = 1 << len(letters)
    rows = failure_masks(docs, filters, id_col, text_col, part_col).groupBy("id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    judged = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    cells = rows.join(judged, "id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))

    def put(vector: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        vector[:, mask] += (n, n * good, n * toxic)
        return vector

    vectors = cells.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(
        lambda row: put(np.zeros((3, n_masks), np.int64), row), put, lambda a, b: a + b
    )
    return spark.createDataFrame(vectors.flatMap(lambda x: _steps(x[0], x[1], letters)), AUDIT)


def _steps(part: str, vector: np.ndarray, letters: list[str]) -> Iterator[tuple]:
    """The rows of a part, from its rows, good rows and toxic rows by mask."""
    masks, n = np.arange(1 << len(letters)), vector[0]

    def gone(before: int, bit: int, of: np.ndarray) -> int:
        return int(of[(masks & bit > 0) & (masks & before == 0)].sum())

    first = {b: {p: [gone(p, b, v) for v in vector] for p in masks.tolist() if not p & b} for b in (1 << k for k in range(len(letters)))}
    orders = [(order, [sum(1 << k for k in order[:i]) for i in range(len(order))]) for order in permutations(range(len(letters)))]
    shapley = dict.fromkeys(first, 0)
    for order, befores in orders:
        for k, before in zip(order, befores, strict=True):
            shapley[1 << k] += first[1 << k][before][0]
    for order, befores in orders:
        name = "".join(letters[k] for k in order)
        for step, (k, before) in enumerate(zip(order, befores, strict=True), 1):
            bit = 1 << k
            removed, good_lost, toxic_lost = first[bit][before]
            kept = int(n[masks & (before | bit) == 0].sum())
            redundant = int(n[masks & bit > 0].sum()) - removed
            yield part, name, step, kept, removed, redundant, int(n[bit]), good_lost, toxic_lost, shapley[bit]
