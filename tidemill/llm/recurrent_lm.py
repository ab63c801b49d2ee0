"""Scores of whole documents by a gated recurrent language model with a class-factored output."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

#: Word classes: the end and the most frequent words alone, others by their last two bytes, the rest by their last byte's remainder.
SINGLES, ENDINGS, RESTS = 30, 33, 8
CLASSES = SINGLES + ENDINGS + RESTS
#: Frequent words, which have an input vector and a place in the softmax of their class; a class has one more place for all its other words.
FREQUENT = 1024
#: Codes of tokens: a frequent word, or FREQUENT plus the class of another; PAD is no token.
CODES = FREQUENT + CLASSES
PAD = CODES
#: Most frequent words that every task holds in a table; the rest are joined.
HEAD_WORDS = 1 << 18
HIDDEN = 24
#: Largest output weight.
LIMIT = 3.0
#: Parts of the training documents, trained on one after the other, and most partitions that groups are dealt to.
ROUNDS, PARTITIONS = 4, 2000
#: Words of a training group, lanes and window of truncated backpropagation, least windows of a group.
GROUP_WORDS, LANES, WINDOW, WINDOWS = 1 << 21, 256, 20, 100
#: Logits that are worked on at a time.
BLOCK = 1 << 16
#: Words that a task scores together, and bytes of texts it splits together.
SCORE_WORDS, SLICE_BYTES = 1 << 21, 16 << 20
#: The end of a document, which no word equals; its code is 0.
END = b""


def _slices(batch: pa.RecordBatch, column: str, most: int):
    """The batch in slices of rows whose ``column`` holds about ``most`` bytes; a larger value is alone."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of ``texts`` in lower case (A to Z only), the place of each word of the texts among them, and the text each belongs to.

    Arrow splits at the white space that words exclude; empty pieces at the edges are left out.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    found = lists.flatten().dictionary_encode()
    place = found.indices.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    nothing = pc.index(found.dictionary, pa.scalar("", found.dictionary.type)).as_py()
    if nothing >= 0:
        real = place != nothing
        place, owner = place[real], owner[real]
    return found.dictionary, place, owner


def word_counts(texts: DataFrame) -> DataFrame:
    """(token, c): how often each word, and the end (the empty string), occurs in the column ``text``; counted in each task before the shuffle."""

    def count(batches):
        for batch in batches:
            for part in _slices(batch, "text", SLICE_BYTES):
                words, place, _ = split_words(part.column("text"))
                n = np.bincount(place, minlength=len(words))
                seen = pa.array(np.flatnonzero(n))
                yield pa.record_batch({"token": words.take(seen).cast(pa.string()), "n": pa.array(n[n > 0].astype(np.int64))})
            yield pa.record_batch({"token": pa.array([""], pa.string()), "n": pa.array([batch.num_rows], pa.int64())})

    partial = texts.select("text").mapInArrow(count, "token string, n long").where("n > 0")
    return partial.groupBy("token").agg(F.sum("n").alias("c"))


def _ending() -> Column:
    return F.substring(F.col("token").cast("binary"), -2, 2)


def _last_two(words: pa.Array) -> np.ndarray:
    """A number for the last two bytes of each word, or its one: the last is its remainder by 256. An empty piece, which is no word, gets 0."""
    if not len(words):
        return np.empty(0, dtype=np.int64)
    _, offsets, data = words.cast(pa.binary()).buffers()
    bounds = np.frombuffer(offsets, dtype=np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.append(np.frombuffer(data or b"", dtype=np.uint8), np.zeros(2, dtype=np.uint8))
    size, stop = np.diff(bounds), bounds[1:]
    return np.where(size > 1, data[stop - 2].astype(np.int64) + 1, 0) * 256 + np.where(size > 0, data[stop - 1], 0)


@dataclass
class Layout:
    """Of each code its class and its place in the softmax of the class; where the places of each class start among all."""

    class_of: np.ndarray
    slot_of: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, class_of: np.ndarray) -> Layout:
        slot_of, starts, at = np.zeros(CODES + 1, dtype=np.int64), np.zeros(CLASSES + 1, dtype=np.int64), 0
        for c in range(CLASSES):
            mine = np.flatnonzero(class_of[:CODES] == c)
            if c >= SINGLES:
                slot_of[mine] = np.arange(len(mine))
                at += len(mine)
            starts[c + 1] = at
        return cls(class_of, slot_of, starts)


@dataclass
class Vocabulary:
    """Codes of the most frequent words, and counts of all."""

    head: pa.Array
    head_code: np.ndarray
    head_log: np.ndarray
    class_by_end: np.ndarray  # of each number of last two bytes
    layout: Layout
    code_words: np.ndarray  # occurrences of each code in training
    other_log: np.ndarray  # of each class: the log of the divisor of its other words' shares
    tokens: int
    kinds: int
    end_known: bool

    def encode(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Codes of words (an array of Arrow, or a list), and their places in the table (-1: none)."""
        words = pa.array(words, pa.binary()) if isinstance(words, list) else words.cast(pa.binary())
        at = pc.fill_null(pc.index_in(words, value_set=self.head), -2).to_numpy(zero_copy_only=False).astype(np.int64) + 1  # place 0 is the end's
        codes = self.head_code[at]
        rare = np.flatnonzero(at < 0)
        codes[rare] = FREQUENT + self.class_by_end[_last_two(words)[rare]]
        return codes, at


def build_vocabulary(counts: DataFrame) -> Vocabulary:
    """Of the table of all counts, what a task needs: bounded tables, and sums over every word."""
    totals = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.when(F.col("token") == "", F.col("c"))), F.lit(0)).alias("ends")
    ).first()
    head = counts.where("token <> ''").orderBy(F.desc("c"), "token").limit(HEAD_WORDS).toArrow()
    words = [END, *head["token"].cast(pa.binary()).to_pylist()]
    c = np.append(int(totals["ends"]), np.array(head["c"].to_pylist(), dtype=np.int64))
    singles = words[:SINGLES]
    rest = counts.where(~F.col("token").isin([w.decode() for w in singles]))
    ends = rest.groupBy(_ending().alias("e")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
    top = ends.orderBy(F.desc("n"), "e").limit(ENDINGS).toArrow()
    endings = top["e"].cast(pa.binary()).combine_chunks()
    class_by_end = SINGLES + ENDINGS + np.arange(257 * 256) % 256 % RESTS
    class_by_end[_last_two(endings)] = SINGLES + np.arange(len(endings))
    by_byte = rest.where(~_ending().isin(endings.to_pylist())).groupBy(F.substring(F.col("token").cast("binary"), -1, 1).alias("b"))
    others = by_byte.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toArrow()
    in_class = class_by_end[_last_two(pa.array(words, pa.binary()))]
    in_class[:SINGLES] = np.arange(len(singles))
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    n[SINGLES : SINGLES + len(endings)], v[SINGLES : SINGLES + len(endings)] = top["n"].to_pylist(), top["v"].to_pylist()
    for b, *found in zip(*(others[k].to_pylist() for k in ("b", "n", "v")), strict=True):
        at = SINGLES + ENDINGS + b[0] % RESTS
        n[at], v[at] = n[at] + found[0], v[at] + found[1]
    often = slice(SINGLES, FREQUENT)
    np.subtract.at(n, in_class[often], c[often])
    np.subtract.at(v, in_class[often], 1)
    code_words = np.zeros(CODES)
    code_words[: min(FREQUENT, len(c))] = c[:FREQUENT]
    code_words[FREQUENT:] = n
    class_of = np.full(CODES + 1, CLASSES, dtype=np.uint8)  # codes without a word have no class
    class_of[: min(FREQUENT, len(words))] = in_class[:FREQUENT]
    class_of[FREQUENT:CODES] = np.arange(CLASSES)
    return Vocabulary(
        pa.array(words[1:], pa.binary()),
        np.where(np.arange(len(words)) < FREQUENT, np.arange(len(words)), FREQUENT + in_class).astype(np.uint16),
        np.log10(c + 0.5),
        class_by_end,
        Layout.of(class_of),
        code_words,
        np.log10(n + 0.5 * (v + 1)),
        int(totals["n"]),
        int(totals["v"]),
        bool(totals["ends"]),
    )


SHAPES = {
    "wx": (CODES, 3 * HIDDEN), "wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "wo": (HIDDEN, CLASSES), "bo": (CLASSES,),
    "ow": (CODES, HIDDEN), "ob": (CODES,),
}


def initial(vocabulary: Vocabulary, seed: int = 3) -> dict:
    """Parameters before training: random, but that the output's offsets are the frequencies of the classes and of the words in them."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    layout, words = vocabulary.layout, vocabulary.code_words + 0.5
    p["wo"] *= 0.1
    p["ow"] *= 0.1
    p["b"][:] = 0
    p["bo"] = np.log(np.bincount(layout.class_of[:CODES], words, CLASSES + 1)[:CLASSES]).astype(np.float32)
    p["bo"] -= np.log(words.sum())
    p["ob"][:] = 0
    mine = np.flatnonzero((layout.class_of[:CODES] >= SINGLES) & (layout.class_of[:CODES] < CLASSES))
    p["ob"][layout.starts[layout.class_of[mine]] + layout.slot_of[mine]] = np.log(words[mine]) - np.log(words[mine]).mean()
    return p


def flat(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES]).astype(np.float32)


def unflat(v: np.ndarray) -> dict:
    """The parameters as views of one array."""
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = v[at : at + n].reshape(s)
        at += n
    return out


class Lanes:
    """Documents (codes, an end last) laid end to end in lanes of nearly equal length, longest first, read window by window.

    Only the codes are held, so the longest document does not set the size of the others' lanes.
    """

    def __init__(self, docs: list[np.ndarray], lanes: int):
        heap = [(0, i) for i in range(lanes)]
        rows: list[list[int]] = [[] for _ in range(lanes)]
        for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
            length, lane = heapq.heappop(heap)
            rows[lane].append(d)
            heapq.heappush(heap, (length + len(docs[d]), lane))
        sizes = [sum(len(docs[d]) for d in row) for row in rows]
        order = sorted(range(lanes), key=lambda i: -sizes[i])
        self.docs = [rows[i] for i in order]
        self.length = np.array([sizes[i] for i in order])
        self.start = np.concatenate(([0], np.cumsum(self.length + 1)[:-1])) + 1
        end = np.zeros(1, dtype=np.uint16)  # the code of the end stands before the first word of a lane
        self.codes = np.concatenate([x for row in self.docs for x in (end, *(docs[d] for d in row))])

    def window(self, t: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Inputs and targets (steps x lanes that are not over); PAD where a lane is over."""
        active = int(np.searchsorted(-self.length, -t, "left"))
        place = t + np.arange(min(steps, int(self.length[0]) - t))[:, None]
        inside = place < self.length[:active]
        at = np.where(inside, place + self.start[:active], 1)
        return np.where(inside, self.codes[at - 1], 0), np.where(inside, self.codes[at], PAD)


def _gates(w: np.ndarray) -> np.ndarray:
    """Columns of the update, the reset and the candidate state, each contiguous."""
    return np.ascontiguousarray(w.reshape(len(w), 3, HIDDEN).transpose(1, 0, 2))


def _starts(entry: np.ndarray) -> list[np.ndarray]:
    """Of each step the lanes that start anew."""
    step, lane = np.nonzero(entry == 0)
    return np.split(lane, np.searchsorted(step, np.arange(1, len(entry))))


def _forward(p: dict, entry: np.ndarray, h: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States after each step of a window, and the last; ``keep`` gets what backpropagation needs. An input of the end starts anew.

    What a step reads and writes lies together gate by gate, so that no operation goes by pieces of a row.
    """
    steps, lanes = entry.shape
    half = np.array([0.5, 0.5, 1], dtype=p["wx"].dtype)[:, None, None]  # a sigmoid is half the tanh of half its argument, and a half
    table, wh, codes = _gates(p["wx"] + p["b"]) * half, _gates(p["wh"]) * half, entry.astype(np.intp)
    x = np.empty((3, steps, lanes, HIDDEN), dtype=table.dtype)  # the gates' arguments, then the gates
    for k in range(3):
        np.take(table[k], codes, axis=0, out=x[k], mode="clip")
    out, un, before = (np.empty((steps, lanes, HIDDEN), dtype=table.dtype) for _ in range(3))
    u = np.empty((2, lanes, HIDDEN), dtype=table.dtype)
    for t, anew in enumerate(_starts(entry)):
        b, g, n, after = before[t], x[:2, t], x[2, t], out[t]
        b[:] = h
        if len(anew):
            b[anew] = 0
        np.matmul(b, wh[:2], out=u)
        np.matmul(b, wh[2], out=un[t])
        g += u
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        np.multiply(g[1], un[t], out=after)
        n += after
        np.tanh(n, out=n)
        np.subtract(b, n, out=after)
        after *= g[0]
        after += n
        h = after
    if keep is not None:
        keep.update(before=before, z=x[0], r=x[1], n=x[2], un=un)
    return out, h


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exponentials of logits and the sums of their rows. States lie within -1 and 1 and output weights within LIMIT, so none overflows."""
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], dtype=z.dtype)


def _softmax(weights: np.ndarray, offsets: np.ndarray, states: np.ndarray, right: np.ndarray, out: np.ndarray, grads: tuple | None) -> None:
    """The probability of the place ``right`` of each state's softmax, into ``out``; into ``grads`` the gradients of the
    loss, summed over the states, by the weights (places x HIDDEN), the offsets and the states.

    Taken in blocks of about BLOCK logits, which stay in a processor's cache from one operation to the next.
    """
    places = len(weights)
    rows = max(16, BLOCK // places)
    across, base = np.ascontiguousarray(weights.T), np.arange(0, min(rows, len(states)) * places, places)
    for lo in range(0, len(states), rows):
        s, mine = states[lo : lo + rows], slice(lo, lo + rows)
        z = s @ across
        z += offsets
        z, whole = _exp(z)
        flat_z, at = z.ravel(), base[: len(s)] + right[mine]
        hit = flat_z.take(at)
        np.divide(hit, whole, out=out[mine])
        if grads is None:
            continue
        flat_z[at] = hit - whole  # z over whole is now the softmax less the target; the narrower factors are divided
        scale = 1 / whole
        by_weights, by_offsets, by_states = grads
        by_weights += z.T @ (s * scale[:, None])
        by_offsets += scale @ z
        np.multiply(z @ weights, scale[:, None], out=by_states[mine])


def _output(p: dict, layout: Layout, states: np.ndarray, target: np.ndarray, g: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probability of each target after its state, and with ``g`` the gradient of their mean loss (g gets the output's, the states' is returned).

    The softmax is factored: that of the class, and within the class that of the frequent words and of all others.
    """
    classes = layout.class_of[target]
    order = np.argsort(classes, kind="stable")
    cuts = np.searchsorted(classes[order], np.arange(SINGLES, CLASSES + 1))
    order, cuts = order[cuts[0] :], cuts - cuts[0]
    s, slots = states.take(order, axis=0), layout.slot_of[target[order]]
    share, inner = np.empty(len(target), dtype=states.dtype), np.ones(len(order), dtype=states.dtype)
    down = more = None
    if g is not None:
        down, more = np.empty_like(states), np.zeros_like(s)
        wo = np.zeros((CLASSES, HIDDEN), dtype=states.dtype)
        g.update(wo=wo.T, bo=np.zeros_like(p["bo"]), ow=np.zeros_like(p["ow"]), ob=np.zeros_like(p["ob"]))
    _softmax(np.ascontiguousarray(p["wo"].T), p["bo"], states, classes, share, None if g is None else (wo, g["bo"], down))
    for c, lo, hi in zip(range(SINGLES, CLASSES), cuts[:-1], cuts[1:], strict=True):
        if lo == hi or layout.starts[c + 1] - layout.starts[c] == 1:
            continue  # a class of one place gives it probability 1
        at = slice(layout.starts[c], layout.starts[c + 1])
        _softmax(p["ow"][at], p["ob"][at], s[lo:hi], slots[lo:hi], inner[lo:hi], None if g is None else (g["ow"][at], g["ob"][at], more[lo:hi]))
    logs = np.log(share)
    logs[order] += np.log(inner)
    if g is not None:
        down[order] += more
        for x in (wo, g["bo"], g["ow"], g["ob"], down):
            x *= 1 / max(1, len(target))
    return logs, down


def _sums_by_code(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of each code the sum of its rows, by gates."""
    out = np.zeros((CODES, 3, HIDDEN), dtype=rows.dtype)
    order = np.argsort(codes, kind="stable")
    first = np.flatnonzero(np.diff(codes[order], prepend=CODES))
    pairs = np.result_type(rows.dtype, np.complex64)  # two columns are added at a time
    for k in range(3):
        out[codes[order[first]], k] = np.add.reduceat(rows[k].take(order, axis=0).view(pairs), first, axis=0).view(rows.dtype)
    return out.reshape(CODES, 3 * HIDDEN)


def _window_gradients(p: dict, layout: Layout, entry: np.ndarray, target: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients over one window of truncated backpropagation, and the state to carry on."""
    keep: dict = {}
    states, last = _forward(p, entry, h, keep)
    steps, lanes = entry.shape
    flat_states, flat_target = states.reshape(-1, HIDDEN), target.ravel()
    g: dict = {}
    real = np.flatnonzero(flat_target != PAD)
    if len(real) == len(flat_target):
        down = _output(p, layout, flat_states, flat_target, g)[1]
    else:
        down = np.zeros_like(flat_states)
        down[real] = _output(p, layout, flat_states[real], flat_target[real], g)[1]
    down = down.reshape(steps, lanes, HIDDEN)
    before, z, r, n, un = (keep[k] for k in ("before", "z", "r", "n", "un"))
    rest = 1 - z
    by_z = before - n
    by_z *= z
    by_z *= rest
    by_n = 1 - n * n
    by_n *= rest
    by_r = 1 - r
    by_r *= r
    by_r *= un
    du = np.empty((3, steps, lanes, HIDDEN), dtype=down.dtype)
    dn = np.empty_like(down)
    dh = np.zeros((lanes, HIDDEN), dtype=down.dtype)
    back = np.empty((3, lanes, HIDDEN), dtype=down.dtype)
    wh, starts = np.ascontiguousarray(_gates(p["wh"]).transpose(0, 2, 1)), _starts(entry)
    for t in range(steps - 1, -1, -1):
        dh += down[t]
        np.multiply(dh, by_n[t], out=dn[t])
        np.multiply(dh, by_z[t], out=du[0, t])
        np.multiply(dn[t], by_r[t], out=du[1, t])
        np.multiply(dn[t], r[t], out=du[2, t])
        dh *= z[t]
        np.matmul(du[:, t], wh, out=back)
        for k in range(3):
            dh += back[k]
        if len(starts[t]):
            dh[starts[t]] = 0
    du = du.reshape(3, -1, HIDDEN)
    g["wh"] = np.matmul(before.reshape(-1, HIDDEN).T, du).transpose(1, 0, 2).reshape(HIDDEN, 3 * HIDDEN)
    du[2] = dn.reshape(-1, HIDDEN)  # from here on the gradient of the input, not of the state
    g["wx"] = _sums_by_code(entry.ravel(), du)
    g["b"] = g["wx"].sum(axis=0)
    return g, last


def even_lanes(docs: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets (steps x lanes) of ``docs`` laid end to end and cut into lanes of equal length; PAD after the last target.

    A lane may begin within a document: its first input is the word before, and its state starts empty there.
    """
    codes = np.concatenate(docs)
    steps = -(-len(codes) // lanes)
    target = np.full(steps * lanes, PAD, dtype=np.uint16)
    target[: len(codes)] = codes
    entry = np.zeros_like(target)
    entry[1 : len(codes)] = codes[:-1]
    return entry.reshape(lanes, steps).T, target.reshape(lanes, steps).T


def train_group(start: np.ndarray, layout: Layout, docs: list[np.ndarray], rate: float) -> np.ndarray:
    """One pass of truncated backpropagation with Adam over the code sequences of ``docs``; parameters as one array."""
    v = start.copy()
    if not docs:
        return v
    p = unflat(v)
    entry, target = even_lanes(docs, max(1, min(LANES, sum(map(len, docs)) // (WINDOW * WINDOWS))))
    m, s, step, root = np.zeros_like(v), np.zeros_like(v), np.empty_like(v), np.empty_like(v)
    h = np.zeros((entry.shape[1], HIDDEN), dtype=v.dtype)
    places = range(0, len(entry), WINDOW)
    for i, t in enumerate(places, 1):
        g, h = _window_gradients(p, layout, np.ascontiguousarray(entry[t : t + WINDOW]), np.ascontiguousarray(target[t : t + WINDOW]), h)
        np.concatenate([g[k].ravel() for k in SHAPES], out=step)
        step *= min(1.0, 1.0 / max(float(np.sqrt(step @ step)), 1e-9))
        m *= 0.9
        m += np.multiply(step, 0.1, out=root)
        s *= 0.99
        step *= step
        s += np.multiply(step, 0.01, out=root)
        pace = rate * min(i / 20, 1.0) * max(0.1, 1 - i / len(places))  # a warm start, and smaller steps to the end
        np.sqrt(s, out=root)
        root += 1e-6 * np.sqrt(1 - 0.99**i)
        np.divide(m, root, out=root)
        root *= pace * np.sqrt(1 - 0.99**i) / (1 - 0.9**i)
        v -= root
        for k in ("wo", "ow"):
            np.clip(p[k], -LIMIT, LIMIT, out=p[k])
    return v


def sequence_logs(p: dict, layout: Layout, docs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each code sequence, the state carried across windows from its first word to its end."""
    if not docs:
        return np.empty(0)
    lanes = Lanes(docs, min(LANES, len(docs)))
    h = np.zeros((len(lanes.length), HIDDEN), dtype=np.float32)
    so_far = np.zeros(len(lanes.length))
    ends: list[list[float]] = [[] for _ in lanes.docs]  # of each lane the sums up to each document's end
    for t in range(0, int(lanes.length[0]), WINDOW):
        entry, target = lanes.window(t, WINDOW)
        active = entry.shape[1]
        states, h = _forward(p, entry, h[:active])
        real = np.flatnonzero((target != PAD).ravel())
        sums = np.zeros(target.size)
        sums[real] = _output(p, layout, states.reshape(-1, HIDDEN)[real], target.ravel()[real])[0]
        sums = sums.reshape(target.shape).cumsum(axis=0) + so_far[:active]
        for step, lane in zip(*np.nonzero(target == 0), strict=True):
            ends[lane].append(sums[step, lane])
        so_far = sums[-1]
    out = np.zeros(len(docs))
    for row, marks in zip(lanes.docs, ends, strict=True):
        if row:
            out[row] = np.diff(marks, prepend=0.0)
    return out / np.log(10)


def _trainer(common, vocabulary, rate: float):
    """What a group does in its round: its own copy of the parameters, trained on its texts, as rows (place, value)."""

    def train_here(table: pa.Table) -> pa.Table:
        docs = [np.frombuffer(x, dtype=np.uint16) for x in table.sort_by("h")["codes"].to_pylist()]
        after = train_group(common.value, vocabulary.value.layout, docs, rate)
        return pa.table({"at": pa.array(np.arange(len(after), dtype=np.int32)), "v": pa.array(after.astype(np.float64))})

    return train_here


def encode_documents(rows: DataFrame, vocabulary) -> DataFrame:
    """``rows`` (doc_id, held_out, text) as codes, read from the texts once for training and scoring.

    Returns rid, doc_id, held_out, words, known (words of the table that training has), logs (the sum
    of log10(c + 0.5) over them and the end), shares (what the model's score adds for the shares of words within the
    other words of their classes), rare (words that the table lacks), codes (two bytes a word, the end
    last), g and round. Each training text belongs to one group of about GROUP_WORDS words and to the
    group's round; -1 marks those held out. A text is dealt by its row's id with it, so that the copies
    of a text are spread over the groups.
    """
    n_groups = ROUNDS * max(1, round(vocabulary.value.tokens / (ROUNDS * GROUP_WORDS)))

    def encode(batches):
        v = vocabulary.value
        for batch in batches:
            for part in _slices(batch, "text", SLICE_BYTES):
                words, place, owner = split_words(part.column("text"))
                n = part.num_rows
                codes, at = v.encode(words)
                log = np.where(at >= 0, v.head_log[at], 0.0)
                share = np.where(codes >= FREQUENT, log - v.other_log[np.maximum(codes, FREQUENT) - FREQUENT], 0.0)
                sizes = np.bincount(owner, minlength=n)
                rare = at[place] < 0
                bounds = np.concatenate(([0], np.cumsum(sizes + 1) * 2)).astype(np.int64)
                all_codes = np.zeros(len(place) + n, dtype=np.uint16)
                all_codes[np.arange(len(place)) + owner] = codes[place]
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "held_out": part.column("held_out"),
                        "h": part.column("h"),
                        "words": pa.array(sizes.astype(np.int64)),
                        "known": pa.array(np.bincount(owner, (at >= 0)[place], n).astype(np.int64) + v.end_known),
                        "logs": pa.array(np.bincount(owner, log[place], n) + v.head_log[0]),
                        "shares": pa.array(np.bincount(owner, share[place], n)),
                        "rare": pa.ListArray.from_arrays(
                            pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner[rare], minlength=n)))).astype(np.int32)),
                            words.take(pa.array(place[rare])).cast(pa.string()),
                        ),
                        "codes": pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(all_codes)]).cast(pa.binary()),
                    }
                )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    encoded = rows.withColumn("h", F.xxhash64(F.lit(23), "doc_id", "text")).mapInArrow(
        encode, f"doc_id {id_type}, held_out boolean, h long, words long, known long, logs double, shares double, rare array<string>, codes binary"
    )
    dealt = encoded.withColumn("g", F.pmod(F.xxhash64(F.lit(29), "h"), F.lit(n_groups)).cast("long"))
    dealt = dealt.withColumn("round", F.when(F.col("held_out"), -1).otherwise(F.pmod("g", F.lit(ROUNDS))).cast("int"))
    dealt = dealt.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "words", "known", "logs", "shares", "rare", "codes", "h", "g", "round")
    return materialize(dealt, "lm-codes", by=["round"])


def train_recurrent(encoded: DataFrame, vocabulary, start: dict) -> dict:
    """Parameters trained on every row of ``encoded`` that is not held out.

    In a round every group trains its own copy from the common parameters, and the copies are averaged
    by an aggregation over their places; the driver gets the average alone, and the next round goes on
    from it.
    """
    spark = encoded.sparkSession
    tokens = vocabulary.value.tokens
    after = flat(start)
    n_groups = max(1, round(tokens / (ROUNDS * GROUP_WORDS)))
    for k in range(ROUNDS):
        common = spark.sparkContext.broadcast(after)
        part = encoded.where(F.col("round") == k).select("g", "h", "codes").repartition(min(n_groups, PARTITIONS), "g")
        copies = part.groupBy("g").applyInArrow(_trainer(common, vocabulary, 0.015 / (1 + k)), "at int, v double")
        averaged = copies.groupBy("at").agg(F.avg("v").alias("v")).toArrow()
        if averaged.num_rows:
            after = after.copy()
            after[averaged["at"].to_numpy()] = averaged["v"].to_numpy()
    return unflat(after)


def score_documents(docs: DataFrame, is_held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows that are not held out are learned from. Tokens are words (A to Z in lower case) and one end
    for each text. ``base_score`` sums log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens. ``score``
    is the log10 probability of the text under the recurrent model: a gated unit reads the words so
    far, its state carried through the whole text, and gives the next word's class and, by a softmax
    within the class, the frequent word or that it is another one; another word's share among those of
    its class comes from the counts over all training rows, unknown words included.

    Every word is counted. The HEAD_WORDS most frequent are looked up in a table that each task
    holds; the others are joined with the counts, so that no task or driver holds them all. A null or
    empty text has one token, its end. Rows are scored one by one, and repeated ones count as often
    as they occur; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(is_held_out, F.lit(False)).alias("held_out"), text_of(text_col).alias("text"))
    counts = materialize(word_counts(rows.where(~F.col("held_out"))), "lm-counts")
    found = build_vocabulary(counts)
    vocabulary = spark.sparkContext.broadcast(found)
    encoded = encode_documents(rows, vocabulary)
    model = spark.sparkContext.broadcast(flat(train_recurrent(encoded, vocabulary, initial(found))))

    def score(batches):
        layout, p = vocabulary.value.layout, unflat(model.value)
        for batch in batches:
            for part in _slices(batch, "codes", 2 * SCORE_WORDS):
                logs = sequence_logs(p, layout, [np.frombuffer(x, dtype=np.uint16) for x in part.column("codes").to_pylist()])
                kept = [part.column(n) for n in part.schema.names if n != "codes"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(logs)], names=[*(n for n in part.schema.names if n != "codes"), "model"])

    rare = encoded.select("rid", F.explode("rare").alias("token"))
    c = F.coalesce("c", F.lit(0))
    joined = (
        rare.join(counts, "token", "left")
        .groupBy("rid")
        .agg(F.sum(F.log10(c + 0.5)).alias("more_logs"), F.count(F.when(F.col("c") > 0, 1)).alias("more_known"))
    )
    narrow = encoded.select("rid", "doc_id", "held_out", "words", "known", "logs", "shares", "codes")
    scored = narrow.mapInArrow(score, narrow.drop("codes").schema.add("model", "double"))
    more = F.coalesce("more_logs", F.lit(0.0))
    n_tokens = F.col("words") + 1
    share = float(np.log10(found.tokens + 0.5 * (found.kinds + 1)))
    return scored.join(joined, "rid", "left").select(
        "doc_id",
        "held_out",
        n_tokens.alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(found.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more - n_tokens * F.lit(share)).alias("base_score"),
        (F.col("model") + F.col("shares") + more).alias("score"),
    )
