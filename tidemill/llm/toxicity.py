"""Toxicity by a support vector machine over a gapped-subsequence string kernel with Nyström landmarks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nlargest
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, text_of, unused

#: Most labelled documents of each class that the machine is fitted on, drawn by a seeded hash.
FIT_DOCS = 1500
#: Most bytes of their texts.
FIT_BYTES = 64 << 20
#: Landmarks of the Nyström approximation.
LANDMARKS = 128
#: Subsequences are of three or four characters that span up to SPAN; each counts DECAY for a character of its span, those of four LONGER times that.
SPAN, DECAY, LONGER = 7, 0.75, 2.0
#: Characters of a piece of a word; longer words are cut into pieces that overlap by half.
PIECE = 24
#: Word scores that a task keeps before it forgets them.
CACHE_WORDS = 400_000
#: Highest values of a text that its probability depends on.
TOPS = 3

#: Codes of characters: 0 a mark, digit or nothing, 1 to 26 letters, START before a word, above it all other letters.
START, CODES = 27, 40
#: Characters that stand for letters in disguised words.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: Letters one by one, with something between them.
SPELLED = re.compile(r"(?<!\w)(?:\w[\W_]{1,3}){3,}\w(?!\w)")
#: Marks that end a word and say nothing of it.
TRAILING = ".,;:!?#*%&$\"')"
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")


def _alphabet() -> np.ndarray:
    """Codes of code points below 0xC0."""
    codes = np.zeros(0xC0, dtype=np.int32)
    for i in range(26):
        codes[ord("a") + i] = codes[ord("A") + i] = 1 + i
    for c, letter in DISGUISE.items():
        codes[ord(c)] = codes[ord(letter)]
    return codes


ALPHABET = _alphabet()
#: Offsets of the second and later characters of a subsequence from its first, and the weight of each.
SHAPES = [(at, DECAY ** (at[-1] + 1) * (LONGER if len(at) == 3 else 1)) for k in (2, 3) for at in combinations(range(1, SPAN), k)]
#: Subsequences of three characters come first in a table of weights, then those of four.
FOURS = CODES**3
TABLE = FOURS + CODES**4


def encode(words: list[str]) -> np.ndarray:
    """Words of at most PIECE characters as rows of codes, each after START."""
    points = np.array(words, dtype=f"U{PIECE}").view(np.uint32).reshape(len(words), PIECE)
    other = START + 1 + (points % np.uint32(CODES - START - 1)).astype(np.int32)
    return np.hstack([np.full((len(words), 1), START), np.where(points < 0xC0, ALPHABET[np.minimum(points, 0xBF)], other)]).astype(np.int32)


def _norms() -> np.ndarray:
    """By the number of codes: the length of the feature vector if no subsequence repeats."""
    n = np.arange(PIECE + 2)
    return np.sqrt(np.maximum(sum(weight**2 * np.maximum(n - at[-1], 0) for at, weight in SHAPES), DECAY**6))


NORMS = _norms()


def lengths(codes: np.ndarray) -> np.ndarray:
    return NORMS[np.count_nonzero(codes, axis=1)]


def each_shape(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each way to leave gaps: the subsequences (places in a table) that begin at each place, and their weight."""
    for at, weight in SHAPES:
        width = codes.shape[1] - at[-1]
        found = codes[:, :width]
        for k in at:
            found = found * CODES + codes[:, k : k + width]
        yield found + (FOURS if len(at) == 3 else 0), weight


def sparse_features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature vector of one word: its subsequences and their weights."""
    spots, weights = [], []
    for at, weight in SHAPES:
        places = np.arange(len(codes) - at[-1])[:, None] + np.array((0, *at))
        letters = codes[places]
        found = letters[(letters != 0).all(axis=1)] @ CODES ** np.arange(len(at), -1, -1) + (FOURS if len(at) == 3 else 0)
        spots.append(found)
        weights.append(np.full(len(found), weight))
    spots, back = np.unique(np.concatenate(spots), return_inverse=True)
    return spots, np.bincount(back, np.concatenate(weights), len(spots)) / lengths(codes[None])[0]


def features(codes: np.ndarray) -> np.ndarray:
    """The feature vector of one word as a table of all subsequences."""
    table = np.zeros(TABLE)
    spots, weights = sparse_features(codes)
    table[spots] = weights
    return table


def values(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The inner product of each word's feature vector with ``table``: linear in the length of the word."""
    out = np.empty(len(codes))
    for lo in range(0, len(codes), 8192):
        part = codes[lo : lo + 8192]
        total = np.zeros(len(part))
        for subsequences, weight in each_shape(part):
            total += weight * table[subsequences].sum(axis=1)
        out[lo : lo + 8192] = total / lengths(part)
    return out


def pieces(word: str) -> list[str]:
    """The word in pieces of at most PIECE characters that overlap by half."""
    return [word] if len(word) <= PIECE else [word[i : i + PIECE] for i in range(0, max(1, len(word) - PIECE // 2), PIECE // 2)]


def words_of(text: str) -> set[str]:
    """The words of a text, and words spelled out letter by letter."""
    text = text.lower()
    words = {w.rstrip(TRAILING) or w for w in text.split()}
    words.update("".join(c for c in m if c.isalnum()) for m in SPELLED.findall(text))
    return words


def sentences_of(text: str) -> list[str]:
    return [s for s in SENTENCE_END.split(text) if s]


def disguised(word: str) -> list[str]:
    """The word with a character inserted, in the ways that the machine shall bear."""
    half = len(word) // 2
    return [".".join(word), "*".join(word), word[:half] + "-" + word[half:], word[:half] + word[half - 1] + word[half:], word[:1] + "*" + word[1:]]


@dataclass
class Toxicity:
    """The folded machine: a weight for each subsequence; the slopes and offset that turn the TOPS highest values of a text into a probability."""

    table: np.ndarray
    slopes: np.ndarray
    offset: float
    floor: float

    def word_values(self, words: list[str]) -> np.ndarray:
        parts, owner = [], []
        for i, w in enumerate(words):
            for p in pieces(w):
                parts.append(p)
                owner.append(i)
        out = np.full(len(words), self.floor)
        if parts:
            np.maximum.at(out, np.array(owner), values(encode(parts), self.table))
        return out

    def probability(self, tops: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(tops @ self.slopes + self.offset, -30, 30)))


#: Bits of the table in which character n-grams are counted.
GRAM_BITS = 22
#: Folds of the labelled texts for calibration, and the most rounds of labelling and fitting.
FOLDS, ROUNDS = 3, 4
#: What a window inside the margin costs, against the ridge.
COST = 1.0
#: The weight of all toxic windows against that of all clean ones.
BALANCE = 0.05


def gram_ids(codes: np.ndarray) -> np.ndarray:
    """For each word the places of its runs of 4 to 6 codes in a hashed table; place 0 is none."""
    found = []
    for n in (4, 5, 6):
        width = codes.shape[1] - n + 1
        key = np.full((len(codes), width), n, dtype=np.uint64)
        for k in range(n):
            key = (key << np.uint64(6)) | codes[:, k : k + width].astype(np.uint64)
        place = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAM_BITS)
        found.append(np.where(codes[:, n - 1 :] == 0, 0, place).astype(np.int32))
    return np.hstack(found)


class Sentences:
    """Labelled texts as sentences of windows: a window is a piece of a word (see ``pieces``), its place in ``codes``.

    ``windows`` lists the windows of all texts without repeats within a sentence; ``sentence`` and
    ``text`` tell to which sentence and which text each belongs.
    """

    def __init__(self, texts: list[str]):
        place: dict[str, int] = {}
        windows, sentence, text = [], [], []
        n = 0
        for t, body in enumerate(texts):
            for part in sentences_of(body):
                mine = {place.setdefault(p, len(place)) for w in words_of(part) for p in pieces(w)}
                windows.extend(sorted(mine))
                sentence.extend([n] * len(mine))
                text.extend([t] * len(mine))
                n += 1
        self.pieces = list(place)
        self.codes = encode(self.pieces).astype(np.uint8) if place else np.zeros((0, PIECE + 1), dtype=np.uint8)
        self.windows, self.sentence, self.text = (np.array(x, dtype=np.int32) for x in (windows, sentence, text))

    def spread(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows of the ``texts`` (marked True), and in how many of them each occurs."""
        mine = texts[self.text]
        pairs = np.unique(self.windows[mine].astype(np.int64) << 32 | self.text[mine])
        found, counts = np.unique(pairs >> 32, return_counts=True)
        return found, counts.astype(np.float64)


def text_counts(data: Sentences, texts: np.ndarray) -> np.ndarray:
    """In how many of the ``texts`` (marked True) each character n-gram occurs."""
    counts = np.zeros(1 << GRAM_BITS, dtype=np.int32)
    starts = np.searchsorted(data.text, np.arange(len(texts) + 1))
    for t in np.flatnonzero(texts):
        mine = np.unique(data.windows[starts[t] : starts[t + 1]])
        counts[np.unique(gram_ids(data.codes[mine]))] += 1
    counts[0] = 0
    return counts


def evidence(data: Sentences, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """How far each window speaks for a toxic text before anything is learned: the log-odds of its most telling n-gram, 0 if none tells.

    An n-gram tells if texts that hold it are toxic more often than others by a likelihood ratio that
    chance would not give any of the n-grams (2 ln of their number). Rates are compared, so that a wrong
    label here and there shuts no n-gram out, and the size of the sample only sharpens the test.
    """
    counts = text_counts(data, toxic), text_counts(data, clean)
    held = np.flatnonzero(counts[0] + counts[1])
    a, b = (c[held].astype(np.float64) for c in counts)
    m, k = max(1, int(toxic.sum())), max(1, int(clean.sum()))

    def part(seen, rest, of):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / of), 0) + np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / of), 0)

    both = a + b
    ratio = 2 * (part(a, m - a, m) + part(b, k - b, k) - part(both, m + k - both, m + k))
    odds = np.log((a + 0.5) / (m + 1)) - np.log((b + 0.5) / (k + 1))
    worth = np.zeros(1 << GRAM_BITS, dtype=np.float32)
    worth[held] = np.where((ratio >= 2 * np.log(max(2, len(held)))) & (odds > 0), odds, 0)
    out = np.zeros(len(data.codes))
    for lo in range(0, len(out), 8192):
        out[lo : lo + 8192] = worth[gram_ids(data.codes[lo : lo + 8192])].max(axis=1)
    return out


def folded(marks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One table of weights that gives what the landmarks' kernel values by ``weights`` add up to."""
    table = np.zeros(TABLE)
    for c, code in zip(weights, marks, strict=True):
        spots, own = sparse_features(code)
        table[spots] += c * own
    return table


def kernel_rows(codes: np.ndarray, marks: np.ndarray, whiten: np.ndarray | None = None) -> np.ndarray:
    """Kernel values of each word with each landmark, times ``whiten``: the words' subsequences that a landmark has, as sparse rows, times the landmarks'."""
    sparse = [sparse_features(c) for c in marks]
    known = np.unique(np.concatenate([spots for spots, _ in sparse]))
    place = np.zeros(TABLE, dtype=np.int32)
    place[known] = np.arange(len(known))
    is_known = np.zeros(TABLE, dtype=bool)
    is_known[known] = True
    dense = np.zeros((len(known), len(marks)), dtype=np.float32)
    for j, (spots, weights) in enumerate(sparse):
        dense[place[spots], j] = weights
    whiten = np.eye(len(marks)) if whiten is None else whiten
    out = np.zeros((len(codes), whiten.shape[1]), dtype=np.float32)
    for lo in range(0, len(codes), 4096):
        part = codes[lo : lo + 4096].astype(np.int32)
        rows, spots, weights = [], [], []
        for subsequences, weight in each_shape(part):
            row, column = np.nonzero(is_known[subsequences])
            rows.append(row)
            spots.append(place[subsequences[row, column]])
            weights.append(np.full(len(row), weight, dtype=np.float32))
        rows, spots, weights = (np.concatenate(x) for x in (rows, spots, weights))
        kernel = np.zeros((len(part), len(marks)), dtype=np.float32)
        if len(rows):
            order = np.argsort(rows, kind="stable")
            rows, spots, weights = rows[order], spots[order], weights[order]
            first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            for i in range(0, len(first), 512):
                end = first[i + 512] if i + 512 < len(first) else len(rows)
                here = slice(first[i], end)
                kernel[rows[first[i : i + 512]]] = np.add.reduceat(dense[spots[here]] * weights[here, None], first[i : i + 512] - first[i], axis=0)
        out[lo : lo + 4096] = kernel / lengths(part)[:, None] @ whiten
    return out


def _squared_hinge(x: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss over ``x[rows]``, by Newton steps on all rows inside the margin."""
    n = x.shape[1]
    w, ridge = np.zeros(n + 1), np.eye(n + 1)
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        left, right = ridge.copy(), np.zeros(n + 1)
        for lo in range(0, len(rows), 16384):
            part = x[rows[lo : lo + 16384]]
            sign, cost = y[lo : lo + 16384], weight[lo : lo + 16384]
            inside = sign * (part @ w[:-1] + w[-1]) < 1
            xs = np.hstack([part[inside], np.ones((int(inside.sum()), 1))])
            left += xs.T @ (cost[inside, None] * xs)
            right += xs.T @ (cost * sign)[inside]
        step = np.linalg.solve(left, right)
        if np.allclose(step, w, atol=1e-6):
            break
        w = step
    return w[:-1], float(w[-1])


def _chosen(candidates: np.ndarray, weight: np.ndarray, most: int) -> np.ndarray:
    """Landmarks by pivoted incomplete Cholesky: each time the window that those so far explain least, by weight."""
    picked: list[int] = []
    factor = np.zeros((len(candidates), min(most, len(candidates))))
    whole = np.array([(sparse_features(c)[1] ** 2).sum() for c in candidates])
    left = whole.copy()
    for j in range(factor.shape[1]):
        i = int(np.argmax(left * weight))
        if left[i] <= 1e-3 * whole[i]:
            break
        column = (values(candidates, features(candidates[i])) - factor[:, :j] @ factor[i, :j]) / np.sqrt(left[i])
        factor[:, j] = column
        left = np.maximum(left - column * column, 0)
        picked.append(i)
    return candidates[picked]


def _best(data: Sentences, telling: np.ndarray, value: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The toxic windows of the ``texts``, and in how many of them each is the best of a sentence.

    A sentence is as toxic as its best window, and counts if that one has a value above 0; windows
    that no evidence speaks for are passed over, so that the labelling does not drift to rare words.
    """
    mine = texts[data.text] & telling[data.windows] & (value[data.windows] > 0)
    window, sentence, text = data.windows[mine], data.sentence[mine], data.text[mine]
    order = np.lexsort((window, -value[window], sentence))
    top = order[np.concatenate(([True], sentence[order][1:] != sentence[order][:-1]))] if len(order) else order
    pairs = np.unique(np.stack([window[top], text[top]], axis=1), axis=0)
    return np.unique(pairs[:, 0], return_counts=True)


@dataclass
class _Map:
    """The Nyström map of all windows of the labelled texts and of the disguised forms of the telling ones."""

    marks: np.ndarray
    whiten: np.ndarray
    x: np.ndarray  # a row for each window, then one for each disguised form
    disguised_of: np.ndarray  # the window that each of these forms disguises

    def values_of(self, n: int, learned: tuple[np.ndarray, float]) -> np.ndarray:
        """Values of the first ``n`` rows."""
        return self.x[:n] @ learned[0].astype(np.float32) + np.float32(learned[1])


def _nystrom(data: Sentences, toxic: np.ndarray, clean: np.ndarray, landmarks: int) -> _Map | None:
    """The map by landmarks among the windows of toxic sentences and the clean windows that resemble them; None if no window tells."""
    telling = evidence(data, toxic, clean)
    found, counts = _best(data, telling > 0, telling, toxic)
    calm, seen = data.spread(clean)
    if not len(found) or not len(calm):
        return None
    marks = _chosen(data.codes[found].astype(np.int32), counts.astype(np.float64), max(1, 2 * landmarks // 3))
    alike = values(data.codes[calm].astype(np.int32), folded(marks, np.ones(len(marks))))
    near = np.argsort(-alike * np.log1p(seen), kind="stable")[: 8 * landmarks]
    more = _chosen(data.codes[calm[near]].astype(np.int32), seen[near], landmarks - len(marks))
    marks = np.unique(np.vstack([marks, more]), axis=0)
    gram = kernel_rows(marks, marks).astype(np.float64)
    root_values, root_vectors = np.linalg.eigh((gram + gram.T) / 2)
    good = root_values > 1e-5 * root_values[-1]
    whiten = root_vectors[:, good] / np.sqrt(root_values[good])
    forms = [(p, i) for i in found if len(data.pieces[i]) >= 4 for d in disguised(data.pieces[i]) for p in pieces(d)]
    hidden = encode([p for p, _ in forms]) if forms else np.zeros((0, PIECE + 1), dtype=np.int32)
    codes = np.vstack([data.codes, hidden.astype(np.uint8)])
    return _Map(marks, whiten, kernel_rows(codes, marks, whiten), np.array([i for _, i in forms], dtype=np.int64))


def _learn(data: Sentences, space: _Map, toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Weights and bias in the map, learned from the sentences of texts marked ``toxic`` and ``clean``; None if nothing tells them apart.

    Multiple-instance learning: every sentence of a clean text is clean, in all its windows; of a toxic
    text the best sentences are toxic, by the evidence first and by the machine itself in later rounds.
    """
    calm, seen = data.spread(clean)
    value = evidence(data, toxic, clean)
    telling = value > 0
    learned = before = None
    for _ in range(ROUNDS):
        found, counts = _best(data, telling, value, toxic)
        if not len(found) or not len(calm) or before is not None and np.array_equal(found, before):
            break
        before = found
        times = np.zeros(len(data.codes))
        times[found] = counts
        forms = np.flatnonzero(times[space.disguised_of])
        positive = np.concatenate([counts, times[space.disguised_of[forms]] / 5])
        weight = np.concatenate([positive * (BALANCE * seen.sum() / positive.sum()), seen])
        sign = np.where(np.arange(len(weight)) < len(positive), 1.0, -1.0)
        learned = _squared_hinge(space.x, np.concatenate([found, len(data.codes) + forms, calm]), sign, COST * weight)
        value = space.values_of(len(data.codes), learned)
    return learned


def _tops(data: Sentences, value: np.ndarray, n_texts: int, floor: float) -> np.ndarray:
    """The TOPS highest values among the different windows of each text, highest first; ``floor`` where it has fewer."""
    pairs = np.unique(data.text.astype(np.int64) << 32 | data.windows)
    text, v = pairs >> 32, value[pairs & 0xFFFFFFFF]
    order = np.lexsort((-v, text))
    text, v = text[order], v[order]
    rank = np.arange(len(text)) - np.searchsorted(text, text)
    out = np.full((n_texts, TOPS), floor)
    here = rank < TOPS
    out[text[here], rank[here]] = v[here]
    return out


#: Takes the TOPS highest values of a text to the means of the highest 1, 2, ...: with slopes of 0 or more no value counts more than a higher one.
RANK_MEANS = np.triu(np.ones((TOPS, TOPS))) / np.arange(1, TOPS + 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Slopes (never below 0) and offset of a logistic regression with a small ridge."""
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    use = list(range(x.shape[1]))
    while True:
        design = np.hstack([(x[:, use] - centre[use]) / scale[use], np.ones((len(x), 1))])
        coef = np.zeros(len(use) + 1)
        penalty = ridge * np.eye(len(use) + 1)
        penalty[-1, -1] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(design @ coef, -30, 30)))
            curve = (p * (1 - p))[:, None]
            coef = coef + np.linalg.solve(design.T @ (curve * design) + penalty, design.T @ (y - p) - penalty @ coef)
        kept = [j for j, c in zip(use, coef, strict=False) if c >= 0]
        if len(kept) == len(use):
            break
        use = kept
    slopes = np.zeros(x.shape[1])
    slopes[use] = coef[:-1] / scale[use]
    return slopes, float(coef[-1] - slopes @ centre)


def _fit(texts: list[str], y: np.ndarray, landmarks: int, rate: float | None = None) -> Toxicity:
    """The machine of all texts, and the slopes that turn its values into probabilities, found on texts held out in turn.

    ``rate`` is the share of toxic texts among all labelled ones, of which these may be an uneven sample.
    """
    data = Sentences(texts)
    y = np.asarray(y, dtype=bool)
    own = (y.sum() + 0.5) / (len(y) + 1)
    rate = own if rate is None else min(max(rate, 1e-6), 1 - 1e-6)
    shift = float(np.log(rate / (1 - rate)) - np.log(own / (1 - own)))
    space = _nystrom(data, y, ~y, landmarks)
    learned = space and _learn(data, space, y, ~y)
    if not learned:
        return Toxicity(np.zeros(TABLE, dtype=np.float32), np.zeros(TOPS), float(np.log(rate / (1 - rate))), 0.0)
    fold = np.random.default_rng(5).permutation(len(y)) % FOLDS
    tops = np.full((len(y), TOPS), -1.0)
    for k in range(FOLDS):
        part = _learn(data, space, y & (fold != k), ~y & (fold != k))
        if part is not None:
            tops[fold == k] = _tops(data, space.values_of(len(data.codes), part), len(y), min(part[1], -1.0))[fold == k]
    slopes, offset = _logistic(tops @ RANK_MEANS, y.astype(float))
    slopes = RANK_MEANS @ slopes
    w, bias = learned
    table = folded(space.marks, space.whiten @ w)
    return Toxicity(table.astype(np.float32), slopes, shift + offset + bias * float(slopes.sum()), min(0.0, -1.0 - bias))


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, landmarks: int = LANDMARKS, fit_bytes: int = FIT_BYTES) -> Toxicity:
    """A machine fitted on the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks 0 or 1.

    Of several labels of one id the highest counts, of several rows the smallest text; null labels and ids are left out. At most
    ``fit_docs`` labels of each class are used, those with the smallest seeded hashes of their ids, and
    of these as many whole texts as ``fit_bytes`` hold, so that what the driver reads is bounded; the
    share of the classes among all labels is counted, and corrects the probabilities.

    The machine learns from labelled sentences: all sentences of a clean text are clean, and of a toxic
    text the best sentences are toxic, chosen anew from round to round. The kernel of two words sums
    over the subsequences of three characters that both hold, with DECAY for each character they span,
    marks in between counting as gaps; a sentence has the value of its most toxic word. Landmarks span
    the feature space, and the machine found there is folded into one weight for each subsequence,
    which gives the same values.
    """
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__y"))
    share = marks.agg(F.avg("__y").alias("rate")).first()["rate"]
    drawn = [marks.where(F.col("__y") == y).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(fit_docs) for y in (1, 0)]
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]).select(F.col("doc_id").alias("__id"), "__y"))
    own = docs.select(F.col("doc_id").alias("__own"), text_of().alias("__text"))
    one = own.join(chosen, F.col("__own") == F.col("__id")).groupBy("__id", "__y").agg(F.min("__text").alias("__text"))
    one = materialize(one.withColumn("__h", F.xxhash64(F.lit(12), "__id")), "toxicity-sample")
    upto = F.sum("__bytes").over(Window.orderBy("__h", "__id").rowsBetween(Window.unboundedPreceding, 0))
    fits = one.select("__id", "__h", F.octet_length("__text").alias("__bytes")).withColumn("__upto", upto).where(F.col("__upto") <= fit_bytes)
    sample = one.join(F.broadcast(fits.select("__id")), "__id", "left_semi").orderBy("__h", "__id").select("__y", "__text").toArrow()
    return _fit(sample["__text"].to_pylist(), sample["__y"].to_numpy() == 1, landmarks, share)


def score_toxicity(docs: DataFrame, model: Toxicity, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``score_col`` (0 to 1): the probability by the highest values among the different words of the whole text.

    Words that are spelled letter by letter are put together first. A null, empty or white-space text
    gets the probability of the lowest value. Rows are scored one by one, so repeated rows get equal
    scores and an empty table gives an empty result; a column of that name is replaced.
    """
    docs = docs.drop(score_col)
    names = docs.columns
    (own_text,) = unused(docs, "__text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model, known = shared.value, {}
        for batch in batches:
            texts = batch.column(own_text)
            tops = np.full((batch.num_rows, TOPS), model.floor)
            for lo in range(0, batch.num_rows, 256):
                sets = [words_of(t) for t in texts.slice(lo, 256).to_pylist()]
                fresh = list(set().union(*sets).difference(known))
                if len(known) + len(fresh) > CACHE_WORDS:
                    known.clear()
                    fresh = list(set().union(*sets))
                known.update(zip(fresh, model.word_values(fresh).tolist(), strict=True))
                get = known.__getitem__
                for i, words in enumerate(sets):
                    best = nlargest(TOPS, map(get, words))
                    tops[lo + i, : len(best)] = best
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(model.probability(tops))], names=[*names, score_col]
            )

    schema = docs.schema.add(score_col, "double")
    return docs.withColumn(own_text, text_of(text_col)).mapInArrow(score, schema)


def held_out(remainder: int, modulus: int, id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder
