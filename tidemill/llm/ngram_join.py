"""Self-join of documents by the Jaccard similarity of their word n-grams, with Bayesian pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, skewed_join, text_of, unused
from .components import connected_components
from .wordhash import gram_hashes, mix, word_hashes

#: Bands times rows of the MinHash index: a pair at similarity 0.8 shares no band with probability 4e-5.
BANDS, ROWS = 26, 5
#: MinHash values that are compared before the posterior is looked at again.
STEP = 10
#: Most rows, and bytes of gram hashes, of one block of a group.
BLOCK_ROWS, BLOCK_BYTES = 1024, 16 << 20
#: Most text keys (8 bytes each) that are broadcast; beyond it they are joined by shuffle.
BROADCAST_KEYS = 1_000_000

_MULTIPLIERS = np.random.default_rng(41).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(threshold: float, tolerance: float, n_hashes: int = BANDS * ROWS, step: int = STEP) -> np.ndarray:
    """For step, 2 step, ... compared values: the fewest matches with which a pair stays.

    With a uniform prior, the similarity after m matches among n is Beta(m + 1, n - m + 1); a pair is
    dropped when the probability that it reaches ``threshold`` is below ``tolerance``.
    """
    s = (np.arange(20000) + 0.5) / 20000
    least = []
    for n in range(step, n_hashes + 1, step):
        m = np.arange(n + 1)[:, None]
        logs = m * np.log(s) + (n - m) * np.log1p(-s)
        density = np.exp(logs - logs.max(axis=1, keepdims=True))
        tail = density[:, s >= threshold].sum(axis=1) / density.sum(axis=1)
        least.append(int(np.argmax(tail >= tolerance)))
    return np.array(least)


def surviving(left: np.ndarray, right: np.ndarray, least: np.ndarray, step: int = STEP) -> np.ndarray:
    """Which pairs of rows of two signature arrays stay: the values are compared ``step`` at a time, pairs dropped on the way."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), dtype=np.int64)
    for k, needed in enumerate(least):
        part = slice(k * step, (k + 1) * step)
        matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= needed]
        if not len(alive):
            break
    return alive


def _sketches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Columns text_key, digest of the set of n-grams (0: none), n_grams, sig (16 bits of each MinHash value) and bands."""
    for batch in batches:
        for lo, hi, words, counts in word_hashes(batch.column("text")):
            grams, runs = gram_hashes(words, counts, n)
            owner = np.repeat(np.arange(hi - lo), runs)
            # a set: repeated grams of a text count once
            order = np.lexsort((grams, owner))
            grams, owner = grams[order], owner[order]
            fresh = np.ones(len(grams), dtype=bool)
            fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
            grams, owner = grams[fresh], owner[fresh]
            size = np.bincount(owner, minlength=hi - lo)
            full = np.flatnonzero(size)
            starts = (np.cumsum(size) - size)[full]
            values = np.zeros((hi - lo, BANDS * ROWS), dtype=np.uint64)
            digest = np.zeros(hi - lo, dtype=np.uint64)
            if len(full):
                for j, a in enumerate(_MULTIPLIERS):
                    values[full, j] = np.minimum.reduceat((grams ^ (a >> np.uint64(7))) * a, starts)
                digest[full] = mix(np.add.reduceat(mix(grams ^ np.uint64(0x5BD1E995)), starts) + size[full].astype(np.uint64)) | np.uint64(1)
            sig = (mix(values) & np.uint64(0xFFFF)).astype(np.uint16)
            bands = np.zeros((hi - lo, BANDS), dtype=np.uint64)
            for r in range(ROWS):
                bands = mix(bands + values[:, r::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
            bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").slice(lo, hi - lo),
                    "text_key": batch.column("text_key").slice(lo, hi - lo),
                    "digest": pa.array(digest.view(np.int64)),
                    "n_grams": pa.array(size.astype(np.int64)),
                    "sig": pa.array([x.tobytes() for x in sig], pa.binary()),
                    "bands": pa.ListArray.from_arrays(
                        np.arange(0, (hi - lo + 1) * BANDS, BANDS, dtype=np.int32), bands.view(np.int64).ravel()
                    ),
                }
            )


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches of rows sorted by ``key``, cut anew so that no group is split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _forest(rows: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected to by the pairs (a, b)."""
    label = np.arange(rows)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _leader_links(batches: Iterator[pa.RecordBatch], least: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Whether each node survives the pruning against its bucket's leader."""
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, BANDS * ROWS) for c in ("sig", "leader_sig"))
        linked = np.zeros(batch.num_rows, dtype=bool)
        linked[surviving(left, right, least)] = True
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("bucket", "leader", "node")], pa.array(linked)], names=["bucket", "leader", "node", "linked"])


def _bucket_links(batches: Iterator[pa.RecordBatch], least: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each task of a block and the loose nodes that visit it, links (a, b) that connect what the pairs that survive the pruning connect.

    Pairs with a loose node are compared, one of them at home in the block.
    """
    for table in _whole_groups(batches, "bucket"):
        keys, node, loose, home = (table[c].to_numpy() for c in ("bucket", "node", "loose", "home"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), dtype=np.uint16).reshape(len(keys), -1)
        pairs_a, pairs_b = [], []
        here = np.arange(len(keys))
        for d in range(1, len(keys)):
            here = here[here + d < len(keys)]
            here = here[keys[here] == keys[here + d]]
            if not len(here):
                break
            wanted = here[(loose[here] | loose[here + d]) & (home[here] | home[here + d])]
            alive = wanted[surviving(sig[wanted], sig[wanted + d], least)]
            pairs_a.append(alive)
            pairs_b.append(alive + d)
        a = np.concatenate(pairs_a) if pairs_a else np.empty(0, dtype=np.int64)
        b = np.concatenate(pairs_b) if pairs_b else np.empty(0, dtype=np.int64)
        root = _forest(len(keys), a, b)
        moved = np.flatnonzero(root != np.arange(len(keys)))
        yield pa.record_batch({"a": pa.array(node[root[moved]]), "b": pa.array(node[moved])})


def _gram_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, words, counts in word_hashes(batch.column("text")):
            grams, runs = gram_hashes(words, counts, n)
            cuts = np.concatenate(([0], np.cumsum(runs)))
            sets = [np.unique(grams[cuts[i] : cuts[i + 1]]).tobytes() for i in range(hi - lo)]
            yield pa.record_batch({"text_key": batch.column("text_key").slice(lo, hi - lo), "grams": pa.array(sets, pa.binary())})


def common_counts(sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """How many elements each two of ``sets`` share; elements of one set alone are left out, the rest taken in slices."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    place = np.cumsum(new) - 1
    times = np.bincount(place)
    shared = times[place] > 1
    rank = np.cumsum(times > 1) - 1
    place, owner = rank[place[shared]], owner[shared]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for lo in range(0, int(rank[-1]) + 1 if len(rank) else 0, columns):
        here = (place >= lo) & (place < lo + columns)
        part = np.zeros((len(sets), columns), dtype=np.float32)
        part[owner[here], place[here] - lo] = 1
        both += part @ part.T
    return both


def linked_pairs(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of ``sets`` whose Jaccard similarity reaches ``threshold``, looked up in stripes of rows."""
    size = np.array([len(s) for s in sets], dtype=np.float32)
    both = common_counts(sets)
    found_a, found_b = [], []
    for lo in range(0, len(sets), 256):
        part = both[lo : lo + 256]
        a, b = np.nonzero((part >= threshold * (size[lo : lo + 256, None] + size[None, :] - part) - 1e-3) & (part > 0))
        after = b > a + lo
        a, b = a[after] + lo, b[after]
        common = both[a, b].astype(np.float64)
        sure = common >= threshold * (size[a].astype(np.float64) + size[b] - common) - 1e-9
        found_a.append(a[sure])
        found_b.append(b[sure])
    return np.concatenate(found_a), np.concatenate(found_b)


def _exact_links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """For each task of a block or two: rows (a, b, links, texts): links that connect, and how many links a node has here."""
    for table in _whole_groups(batches, "task"):
        keys, node, side, weight = (table[c].to_numpy() for c in ("task", "node", "side", "weight"))
        grams = table["grams"]
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        out = {k: [] for k in ("a", "b", "links", "texts")}
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            sets = [np.frombuffer(g.as_buffer(), dtype=np.uint64) for g in grams[lo:hi]]
            a, b = linked_pairs(sets, threshold)
            keep = (side[lo + a] == 0) | (side[lo + a] != side[lo + b])
            a, b = a[keep], b[keep]
            root = _forest(hi - lo, a, b)
            links, texts = np.zeros(hi - lo, dtype=np.int64), np.zeros(hi - lo, dtype=np.int64)
            for x, y in ((a, b), (b, a)):
                np.add.at(links, x, weight[lo + y])
                np.add.at(texts, x, 1)
            out["a"].append(node[lo:hi][root])
            out["b"].append(node[lo:hi])
            out["links"].append(links)
            out["texts"].append(texts)
        yield pa.record_batch({k: pa.array(np.concatenate(v)) for k, v in out.items()})


def in_blocks(rows: DataFrame, group: str, bytes_col: str | None = None) -> DataFrame:
    """Rows of groups as rows of tasks: adds ``task`` and ``side``, so that any two rows of a group meet in one task.

    A group over BLOCK_ROWS rows or BLOCK_BYTES bytes is cut into blocks by a hash of its nodes; a task is
    a block (side 0) or two different blocks (sides 1 and 2). The number of blocks is a power of two, so that
    groups with the same nodes have the same blocks, and name the same links. No task holds more than about two blocks,
    whatever the size of the group.
    """
    size = F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum(bytes_col) / BLOCK_BYTES) if bytes_col else F.lit(1)
    ).cast("long")
    size = F.pow(F.lit(2.0), F.ceil(F.log2(size.cast("double")))).cast("long")
    blocks = rows.groupBy(group).agg(F.count(F.lit(1)).alias("members"), size.alias("n_blocks")).where("members > 1").drop("members")
    joined = rows.join(blocks, group)
    own = F.pmod(F.xxhash64(F.lit(17), "node"), F.col("n_blocks"))
    dealt = joined.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    task = F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other"))
    return dealt.withColumn("task", task).withColumn("side", side.cast("int")).drop("own", "other", "n_blocks")


def loose_blocks(rows: DataFrame, group: str) -> DataFrame:
    """Rows (node, loose, members: the size of the group) of groups as rows of tasks: every node is at home in one block of its group, loose ones visit all of them.

    So any pair with a loose node meets in a task, and n nodes of which r are loose make
    n + r n / BLOCK_ROWS rows. Groups with the same nodes have the same blocks.
    """
    size = F.pow(F.lit(2.0), F.ceil(F.log2(F.ceil(F.col("members") / BLOCK_ROWS).cast("double")))).cast("long")
    own = F.pmod(F.xxhash64(F.lit(17), "node"), F.col("n_blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)
    dealt = rows.withColumn("n_blocks", size).withColumn("own", own).withColumn("block", F.explode(F.when(F.col("loose"), every).otherwise(F.array("own"))))
    return dealt.withColumn("task", F.xxhash64(group, "block")).withColumn("home", F.col("own") == F.col("block")).drop("own", "block", "n_blocks", "members")


def ngram_join(
    docs: DataFrame,
    threshold: float = 0.8,
    n: int = 5,
    tolerance: float = 1e-5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, n_links, n_texts, class_size, kept.

    Two rows are linked when the Jaccard similarity of their sets of word ``n``-grams is at least
    ``threshold``; a class is what links connect, named by its smallest id, whose row is ``kept``.
    ``n_links`` counts the rows that a row is linked to, ``n_texts`` the different n-gram sets among
    them without its own.

    Rows with the same set of n-grams are one node. Nodes that share a MinHash band are candidates;
    their values are compared step by step and a pair is dropped once the posterior probability that
    it reaches ``threshold`` is below ``tolerance``. What survives is connected into groups, and
    within a group every pair is verified exactly, in blocks of bounded size, so that no pair becomes
    a row and no group a task; the links are counted and connected again. A link that the pruning missed
    is found there as well if other pairs connect its two ends. A group of n different texts costs n**2 / 2
    comparisons, because every link is counted, and n**2 / BLOCK_ROWS rows that carry texts' n-gram sets
    to the tasks that compare two blocks (equal texts are one, however many).

    Words are runs of characters other than white space. A text with fewer than ``n`` words has one
    n-gram, the whole; a null or empty text, or one of white space, has none: it has no link and is a
    class of its own. Ids are read as long; one that is no number counts as null. Nodes and texts are known
    by 64-bit hashes: among n of them two meet with probability n**2 / 2**65. A null id ranks last in a class; of repeated rows with the same id one is
    kept, and all are linked to each other. Columns other than the id and text are ignored; an empty
    table gives an empty result.
    """
    return _classes(docs, threshold, n, tolerance, id_col, text_col).drop("text_key")


def _classes(docs: DataFrame, threshold: float, n: int, tolerance: float, id_col: str, text_col: str) -> DataFrame:
    """What ``ngram_join`` returns, and the rows' text_key."""
    least = least_matches(threshold, tolerance)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    sketch_type = "doc_id long, text_key long, digest long, n_grams long, sig binary, bands array<long>"
    sketches = materialize(texts.mapInArrow(lambda it: _sketches(it, n), sketch_type).withColumn("rid", F.monotonically_increasing_id()), "join-sketches")
    filled = sketches.where("n_grams > 0")
    nodes = filled.groupBy("digest").agg(F.min("text_key").alias("text_key"), F.count(F.lit(1)).alias("weight"), F.max("n_grams").alias("n_grams"))

    # candidates: buckets with more than one node
    banded = materialize(filled.select(F.col("digest").alias("node"), F.explode("bands").alias("bucket")).distinct(), "join-bands")
    sizes = materialize(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "join-sizes")
    crowded = materialize(skewed_join(banded, sizes, ["bucket"], "members", "left_semi"), "join-buckets")
    near = crowded.select(F.col("node").alias("digest")).distinct()
    sigs = filled.join(near, "digest", "left_semi").groupBy("digest").agg(F.first("sig").alias("sig"))
    sigs = materialize(sigs.select(F.col("digest").alias("node"), "sig"), "join-sigs")
    # each bucket's first node is compared with all; pairs of two nodes that it links need no look, the others meet in blocks
    leaders = crowded.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("members"))
    leaders = materialize(leaders.join(sigs.select(F.col("node").alias("leader"), F.col("sig").alias("leader_sig")), "leader"), "join-leaders")
    led = skewed_join(crowded, leaders, ["bucket"], "members").where("node <> leader").join(sigs, "node")
    judged = materialize(led.mapInArrow(lambda it: _leader_links(it, least), "bucket long, leader long, node long, linked boolean"), "join-led")
    apart = judged.where("not linked")
    opened = materialize(leaders.select("bucket", "members").join(apart.select("bucket").distinct(), "bucket", "left_semi"), "join-open")
    left_over = skewed_join(crowded, opened, ["bucket"], "members").join(apart.select("bucket", "node", F.lit(True).alias("loose")), ["bucket", "node"], "left")
    left_over = materialize(left_over.withColumn("loose", F.coalesce("loose", F.lit(False))), "join-loose")
    tasks = loose_blocks(left_over, "bucket").select("node", "loose", "home", F.col("task").alias("bucket")).join(sigs, "node")
    loose_links = (
        tasks.repartition("bucket").sortWithinPartitions("bucket", "node")
        .mapInArrow(lambda it: _bucket_links(it, least), "a long, b long")
    )
    links = judged.where("linked").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct().unionByName(loose_links)
    groups = materialize(connected_components(links), "join-groups")

    # exact verification within the groups
    inside = groups.join(nodes.select(F.col("digest").alias("node"), "text_key", "weight", "n_grams"), "node")
    inside = materialize(inside.withColumn("bytes", F.col("n_grams") * 8), "join-inside")
    keys = inside.select("text_key").distinct()
    few = keys.count() <= BROADCAST_KEYS
    bodies = texts.select("text_key", "text").join(F.broadcast(keys) if few else keys, "text_key", "left_semi")
    sets = bodies.mapInArrow(lambda it: _gram_sets(it, n), "text_key long, grams binary").dropDuplicates(["text_key"])
    sets = materialize(inside.select("node", "text_key").join(sets, "text_key").select("node", "grams"), "join-sets")
    dealt = in_blocks(inside.select("node", "component", "weight", "bytes"), "component", "bytes").select("node", "task", "side", "weight")
    exact = materialize(
        dealt.join(sets, "node").repartition("task").sortWithinPartitions("task", "node")
        .mapInArrow(lambda it: _exact_links(it, threshold), "a long, b long, links long, texts long"),
        "join-links",
    )
    degree = exact.groupBy(F.col("b").alias("digest")).agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    classes = connected_components(exact.select("a", "b")).select(F.col("node").alias("digest"), "component")
    about = nodes.select("digest", "weight").join(degree, "digest", "left").join(classes, "digest", "left")

    found = (
        skewed_join(sketches.select("rid", "doc_id", "text_key", "digest", "n_grams"), materialize(about, "join-nodes"), ["digest"], "weight", "left")
        .select(
            "rid", "doc_id", "text_key",
            F.when(F.col("n_grams") == 0, F.lit(0)).otherwise(F.coalesce("component", "digest")).alias("cls"),
            F.when(F.col("n_grams") == 0, F.col("rid")).otherwise(F.lit(0)).alias("alone"),
            (F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).alias("n_links"),
            F.coalesce("texts", F.lit(0)).alias("n_texts"),
        )
    )
    found = materialize(found, "join-found")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid"))
    heads = found.groupBy("cls", "alone").agg(first.alias("first"), F.count(F.lit(1)).alias("class_size"))
    return skewed_join(found, materialize(heads, "join-heads"), ["cls", "alone"], "class_size").select(
        "doc_id", F.col("first.doc_id").alias("class_id"), "n_links", "n_texts", "class_size",
        (F.col("first.rid") == F.col("rid")).alias("kept"), "text_key",
    )


def _row_key(doc_id: Column, text_key: Column) -> Column:
    return F.concat(F.coalesce(F.concat(F.lit("+"), doc_id.cast("string")), F.lit("-")), F.lit(":"), text_key.cast("string"))


def drop_near_duplicates(
    docs: DataFrame,
    threshold: float = 0.8,
    n: int = 5,
    tolerance: float = 1e-5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that ``ngram_join`` keeps: of each class the one with the smallest id.

    Of repeated rows with the same id, those with equal texts count as one row, which stays once. The
    join that picks the rows and the window that leaves one of them have the same key, so that texts
    are shuffled once at most.
    """
    c_key, c_once = unused(docs, "__key", "__once")
    kept = _classes(docs, threshold, n, tolerance, id_col, text_col).where("kept")
    kept = kept.select(_row_key(F.col("doc_id"), F.col("text_key")).alias(c_key)).distinct()
    key = _row_key(F.col(id_col).cast("long"), F.xxhash64(text_of(text_col)))
    once = Window.partitionBy(c_key).orderBy(F.lit(0))
    return (
        docs.withColumn(c_key, key)
        .join(kept, c_key, "left_semi")
        .withColumn(c_once, F.row_number().over(once))
        .where(F.col(c_once) == 1)
        .select(*docs.columns)
    )
