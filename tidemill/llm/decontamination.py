"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, unused
from .wordhash import MARKS, gram_hashes, word_hashes

#: Words of the shortest tile, and of a seed.
SEED_WORDS = 5
#: Most bytes of benchmark text that are sent to the executors at once; a larger benchmark is taken in blocks, one pass each.
BLOCK_BYTES = 16 << 20


class Items:
    """Benchmark items as hashed words, with the seeds of all of them in one sorted array."""

    def __init__(self, ids: list, texts: pa.Array, seed_words: int):
        self.ids = ids
        sizes, seeds, owners, places = [], [], [], []
        short: dict[int, list] = {}
        for lo, hi, hashes, counts in word_hashes(texts, MARKS):
            grams, runs = gram_hashes(hashes, counts, seed_words)
            owner = np.repeat(np.arange(lo, hi), runs)
            full = np.repeat(counts >= seed_words, runs)
            sizes.append(counts)
            seeds.append(grams[full])
            owners.append(owner[full])
            places.append((np.arange(len(grams)) - np.repeat(np.cumsum(runs) - runs, runs))[full])
            for k in range(1, seed_words):
                mine = np.flatnonzero(counts == k)
                if len(mine):
                    first = (np.cumsum(counts) - counts)[mine]
                    own = hashes[(first[:, None] + np.arange(k)).ravel()]
                    short.setdefault(k, []).append((gram_hashes(own, np.full(len(mine), k), k)[0], lo + mine))
        seeds, owners, places = (np.concatenate(x) if x else np.empty(0, dtype=np.uint64) for x in (seeds, owners, places))
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owners, self.places = seeds[order], owners[order].astype(np.int64), places[order].astype(np.int64)
        self.sizes = np.concatenate(sizes) if sizes else np.empty(0, dtype=np.int64)
        #: by number of words, of items too short for a seed: the hash of the whole item (sorted), and the item
        self.short = {}
        for k, parts in short.items():
            grams, items = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(grams, kind="stable")
            self.short[k] = grams[order], items[order]


def seed_runs(at: np.ndarray, place: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Maximal matches (words, start in the text, start in the item) that overlapping seeds on one diagonal make up."""
    order = np.lexsort((at, at - place))
    at, place = at[order], place[order]
    first = np.ones(len(at), dtype=bool)
    first[1:] = (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1] + 1)
    heads = np.flatnonzero(first)
    seeds = np.diff(np.append(heads, len(at)))
    return [(int(n) + length - 1, int(at[h]), int(place[h])) for h, n in zip(heads, seeds, strict=True)]


def greedy_tiles(matches: list[tuple[int, int, int]], size: int, length: int) -> list[tuple[int, int, int]]:
    """Tiles of greedy string tiling: the longest match first, then what the tiles so far leave of the others.

    A match is cut where a word of the text or of the item belongs to a tile already; pieces under
    ``length`` words are dropped. Ties go to the first in the text, then in the item.
    """
    marked_text: set[int] = set()
    marked_item = np.zeros(size, dtype=bool)
    queue = [(-n, at, place) for n, at, place in matches]
    heapq.heapify(queue)
    tiles = []
    while queue:
        n, at, place = heapq.heappop(queue)
        n = -n
        free = [not marked_item[place + k] and at + k not in marked_text for k in range(n)]
        if all(free):
            tiles.append((n, at, place))
            marked_text.update(range(at, at + n))
            marked_item[place : place + n] = True
            continue
        start = None
        for k in range(n + 1):
            open_here = k < n and free[k]
            if open_here and start is None:
                start = k
            elif not open_here and start is not None:
                if k - start >= length:
                    heapq.heappush(queue, (start - k, at + start, place + start))
                start = None
    return tiles


def _at_least(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and counts without the texts of fewer than ``k`` words, which keep their place with none."""
    return words[np.repeat(counts >= k, counts)], np.where(counts >= k, counts, 0)


def tilings(texts: pa.Array, items: Items, threshold: float, length: int) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, coverage, tiles, longest tile in words) of the pairs whose tiles cover at least ``threshold`` of the item."""
    for lo, hi, words, counts in word_hashes(texts, MARKS):
        for k, (wanted, owners) in items.short.items():
            grams, runs = gram_hashes(*_at_least(words, counts, k), k)
            low, high = np.searchsorted(wanted, grams, "left"), np.searchsorted(wanted, grams, "right")
            hit = np.flatnonzero(high > low)
            row = np.searchsorted(np.cumsum(runs), hit, "right")
            for r, o in sorted({(int(r), int(o)) for r, h in zip(row, hit, strict=True) for o in owners[low[h] : high[h]]}):
                yield lo + r, o, 1.0, 1, k
        grams, runs = gram_hashes(words, counts, length)
        left = np.searchsorted(items.seeds, grams, "left")
        hit = np.flatnonzero((left < len(items.seeds)) & (items.seeds[np.minimum(left, len(items.seeds) - 1)] == grams)) if len(items.seeds) else np.empty(0, dtype=np.int64)
        if not len(hit):
            continue
        n_each = np.searchsorted(items.seeds, grams[hit], "right") - left[hit]
        place_in_seeds = np.repeat(left[hit] - (np.cumsum(n_each) - n_each), n_each) + np.arange(n_each.sum())
        gram = np.repeat(hit, n_each)
        starts = np.cumsum(runs) - runs
        row = np.searchsorted(np.cumsum(runs), gram, "right")
        at = gram - starts[row]
        owner, place = items.owners[place_in_seeds], items.places[place_in_seeds]
        order = np.lexsort((owner, row))
        row, owner, at, place = row[order], owner[order], at[order], place[order]
        cuts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (owner[1:] != owner[:-1]), [True])))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            item, size = int(owner[a]), int(items.sizes[owner[a]])
            # seeds bound what tiles can cover
            reach = np.zeros(size + 1, dtype=np.int64)
            spots = np.unique(place[a:b])
            np.add.at(reach, spots, 1)
            np.add.at(reach, spots + length, -1)
            if np.count_nonzero(np.cumsum(reach)[:size]) < threshold * size:
                continue
            tiles = greedy_tiles(seed_runs(at[a:b], place[a:b], length), size, length)
            covered = sum(t[0] for t in tiles) / size
            if covered >= threshold:
                yield lo + int(row[a]), item, covered, len(tiles), tiles[0][0]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, length: int):
    """The benchmark in blocks of bounded size, each ready for the executors."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), text_of(text_col).alias("text")).where("text <> ''")
    total = items.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    n_blocks = max(1, -(-int(total) // BLOCK_BYTES))
    for k in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).orderBy("item_id", "text").toArrow()
        yield benchmark.sparkSession.sparkContext.broadcast(Items(part["item_id"].to_pylist(), part["text"], length))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.5,
    seed_words: int = SEED_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each pair of a document and a benchmark item whose tiles cover at least ``threshold`` of the item's words.

    Returns doc_id, item_id, coverage, n_tiles and longest_tile (words). Words are runs of letters
    and digits in lower case (all beyond ASCII counts as letters), so that case, white
    space and punctuation don't matter, and tiles are taken in any order, so that neither does the
    order of passages. Both sides' runs of ``seed_words`` words are hashed by Karp-Rabin and joined on
    the hashes; seeds that follow one another on a diagonal are maximal matches, of which the longest
    is marked again and again.

    The benchmark is sent to the executors in blocks of at most BLOCK_BYTES; documents are read once
    for each block and never shuffled. Null, empty and white-space texts and items match nothing; an
    item under ``seed_words`` words matches a text that holds it as a run of whole words. Ids are read as
    long; one that is no number becomes null. Repeated documents or items give repeated rows; other
    columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text_of(text_col)).alias("text"))
    bench = benchmark.withColumn("text", F.lower(text_of("text")))
    found = None
    for block in _blocks(bench, "item_id", "text", seed_words):

        def match(batches, block=block):
            items = block.value
            for batch in batches:
                ids = batch.column("doc_id")
                hits = list(tilings(batch.column("text"), items, threshold, seed_words))
                yield pa.record_batch(
                    {
                        "doc_id": ids.take(pa.array([h[0] for h in hits], pa.int64())),
                        "item_id": pa.array([items.ids[h[1]] for h in hits], pa.int64()),
                        "coverage": pa.array([h[2] for h in hits], pa.float64()),
                        "n_tiles": pa.array([h[3] for h in hits], pa.int64()),
                        "longest_tile": pa.array([h[4] for h in hits], pa.int64()),
                    }
                )

        part = rows.mapInArrow(match, "doc_id long, item_id long, coverage double, n_tiles long, longest_tile long")
        found = part if found is None else found.unionByName(part)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, seed_words: int = SEED_WORDS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that match no benchmark item as ``find_contamination`` defines it, with all their columns."""
    bench = benchmark.withColumn("text", F.lower(text_of("text")))
    columns = docs.columns
    (lower,) = unused(docs, "__lower")
    for block in _blocks(bench, "item_id", "text", seed_words):

        def clean(batches, block=block):
            for batch in batches:
                hits = {h[0] for h in tilings(batch.column(lower), block.value, threshold, seed_words)}
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[list(hits)] = False
                yield batch.select(columns).filter(pa.array(keep))

        docs = docs.withColumn(lower, F.lower(text_of(text_col))).mapInArrow(clean, docs.schema)
    return docs
