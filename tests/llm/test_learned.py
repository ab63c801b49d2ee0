"""Near duplicates, decontamination, extraction, toxicity, LM scoring and the pipeline against plain Python."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import html_extraction as he
from tidemill.llm import queries as q
from tidemill.llm import recurrent_lm as lm
from tidemill.llm import toxicity as tox
from tidemill.llm.decontamination import decontaminate, find_contamination, greedy_tiles
from tidemill.llm.ngram_join import drop_near_duplicates, least_matches, ngram_join
from tidemill.llm.toxicity import encode, features, fit_toxicity, score_toxicity, values

LONG = " ".join(f"w{i}" for i in range(40))
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, LONG), (6, LONG + " tail"), (7, "a b"), (8, "a  b"), (9, "wörd " * 30000), (None, LONG), (5, LONG), (10, LONG.replace("w20", "zz"))]


def gram_sets(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return sets


def brute_join(rows):
    sets = gram_sets(rows)
    links, root = Counter(), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    classes = {}
    for i, (d, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(d)
    first = {k: min((d for d in v if d is not None), default=None) for k, v in classes.items()}
    return Counter((d, first[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def test_join_against_brute_force(spark, docs_of, sf_dir):
    for rows in (ODD, [(r["doc_id"], r["text"]) for r in q.table(spark, sf_dir, "documents").collect()]):
        got = ngram_join(docs_of(rows)).collect()
        assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_join(rows)
    assert ngram_join(docs_of([])).count() == 0
    kept = drop_near_duplicates(docs_of(ODD))
    assert kept.columns == docs_of([]).columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 7, 9, 10]


def test_join_in_blocks(docs_of, monkeypatch):
    from tidemill.llm import ngram_join as module

    monkeypatch.setattr(module, "BLOCK_ROWS", 4)
    rows = [(i, LONG.replace(f"w{i}", f"v{i}")) for i in range(23)]
    got = ngram_join(docs_of(rows)).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_join(rows)


def test_pruning_bounds():
    least = least_matches(0.8, 1e-5)
    assert (np.diff(least) > 0).all() and least[-1] < 0.8 * 130


def test_contamination(spark, docs_of):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "", 0), (4, "two words", 0)], "item_id long, text string, doc_id long")
    rows = [
        (1, f"x y {item.upper()}, z"), (2, "eta theta iota kappa lambda mu -- alpha beta gamma delta epsilon zeta"), (3, "alpha beta gamma delta epsilon only"),
        (4, None), (5, ""), (6, "two  words!"), (7, "two  Words more"), (11, "two three words"), (12, "about two words"), (8, item), (8, item), (9, "filler " * 20000 + item),
    ]
    found = find_contamination(docs_of(rows), bench)
    got = Counter((r.doc_id, r.item_id, r.n_tiles) for r in found.collect())
    assert got == Counter({(1, 1, 1): 1, (2, 1, 2): 1, (6, 4, 1): 1, (7, 4, 1): 1, (12, 4, 1): 1, (8, 1, 1): 2, (9, 1, 1): 1})
    clean = decontaminate(docs_of(rows), bench)
    assert clean.columns == docs_of([]).columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 11]
    assert find_contamination(docs_of([]), bench).count() == 0 and find_contamination(docs_of(rows), bench.limit(0)).count() == 0


def brute_tiling(text, item, length=5, threshold=0.5):
    """Greedy string tiling by its definition: again and again the longest common run of unmarked words, the first in the text, then in the item."""
    a, b = (re.findall(r"[a-z0-9\x80-\U0010ffff]+", x.lower()) for x in (text, item))
    if not b:
        return None
    if len(b) < length:
        return (1.0, 1, len(b)) if any(a[i : i + len(b)] == b for i in range(len(a) - len(b) + 1)) else None
    free_a, free_b, tiles = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < length:
            break
        tiles.append(n)
        free_a[i : i + n] = free_b[j : j + n] = [False] * n
    covered = sum(tiles) / len(b)
    return (covered, len(tiles), tiles[0]) if tiles and covered >= threshold else None


def test_tiling_against_brute_force(spark, docs_of):
    draw = random.Random(9)
    words = ["ab", "cd", "ef", "gh", "ij", "kl"]  # few words, so that runs repeat and overlap
    items = [" ".join(draw.choice(words) for _ in range(n)) for n in (1, 3, 4, 5, 8, 13, 20, 30) for _ in range(3)]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 60))) for _ in range(40)]
    texts += [f"{texts[i]}. {items[-i - 1].upper()}, {' '.join(reversed(items[-i - 2].split()))}" for i in range(10)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = find_contamination(docs_of(list(enumerate(texts))), bench).collect()
    want = {(d, i): r for d, t in enumerate(texts) for i, x in enumerate(items) if (r := brute_tiling(t, x))}
    assert len(found) == len(want) and {(r.doc_id, r.item_id): (pytest.approx(r.coverage), r.n_tiles, r.longest_tile) for r in found} == want


def test_tiles_cut_overlaps():
    assert greedy_tiles([(8, 0, 0), (9, 5, 6)], 15, 3) == [(9, 5, 6), (5, 0, 0)]


def brute_vector(word):
    """Subsequences of three and four letters of the marked word by their places, one by one."""
    letters = [("^", 0)] + [(tox.DISGUISE.get(c, c), i + 1) for i, c in enumerate(word)]
    letters = [(c, i) for c, i in letters if c == "^" or c.isalpha()]
    found = Counter()
    for k in (3, 4):
        for group in itertools.combinations(letters, k):
            span = group[-1][1] - group[0][1] + 1
            if span <= tox.SPAN:
                found["".join(c for c, _ in group)] += tox.DECAY**span * (tox.LONGER if k == 4 else 1)
    shapes = [span for k in (3, 4) for span in (at[-1] for at in itertools.combinations(range(1, tox.SPAN), k - 1))]
    weights = [tox.DECAY ** (at[-1] + 1) * (tox.LONGER if k == 4 else 1) for k in (3, 4) for at in itertools.combinations(range(1, tox.SPAN), k - 1)]
    norm = sum(w * w * max(len(letters) - span, 0) for w, span in zip(weights, shapes, strict=True))
    return {k: v / max(norm, tox.DECAY**6) ** 0.5 for k, v in found.items()}


def test_string_kernel_against_brute_force():
    words = ["idiot", "i.d.i.o.t", "1d1ot", "idot", "idiiot", "banana", "xyz", "ab", "", "worthlessness", "hahahahaha", "no-good!"]
    codes = encode(words)
    vectors = [brute_vector(w) for w in words]
    rows = tox.kernel_rows(codes, codes)
    for j, v in enumerate(vectors):
        got = values(codes, features(codes[j]))
        for i, u in enumerate(vectors):
            want = sum(x * v.get(k, 0) for k, x in u.items())
            assert got[i] == pytest.approx(want, abs=1e-9) and rows[i, j] == pytest.approx(want, abs=1e-4), (words[i], words[j])
    assert values(codes, features(codes[0]))[1:5].min() > 0.2 > values(codes, features(codes[0]))[5]


def test_machine_is_the_kernel_expansion():
    """The folded table gives what the landmarks' kernel values add up to, and Newton's steps reach the least loss."""
    rng = np.random.default_rng(2)
    marks, codes = encode(["idiot", "moron", "table"]), encode(["idiots", "mooron", "chair", "tab.le"])
    w = np.array([1.5, -0.5, 2.0])
    assert values(codes, tox.folded(marks, w)) == pytest.approx(tox.kernel_rows(codes, marks) @ w, abs=1e-4)
    x, y, cost = rng.standard_normal((60, 3)), np.where(rng.random(60) < 0.4, 1.0, -1.0), rng.random(60) + 0.1
    found = np.append(*tox._squared_hinge(x, np.arange(60), y, cost))

    def loss(v):
        return 0.5 * (v[:3] @ v[:3] + 1e-3 * v[3] ** 2) + 0.5 * (cost * np.maximum(0, 1 - y * (x @ v[:3] + v[3])) ** 2).sum()

    assert all(loss(found) <= loss(found + d) + 1e-9 for d in rng.standard_normal((200, 4)) * 0.01)


def test_toxicity_held_out(spark):
    """On the labels of a larger table: no worse than the best word of a log-ratio, and sure of what it marks."""
    at = "/root/testdata/sf0.01"
    rows = [r for r in q.op9_toxicity(spark, at).join(q.table(spark, at, "labels"), "doc_id").where("held_out").select("score", "predicted", "toxic").collect()]
    good, bad = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) >= 0.9
    marked = [r for r in rows if r.predicted]
    assert len(marked) >= 0.7 * len(good) and np.mean([r.toxic for r in marked]) >= 0.95


def test_toxicity_with_wrong_labels(spark, docs_of):
    calm = ["lorem", "ipsum", "dolor", "amet", "tempor", "magna", "aliqua", "veniam", "nostrud", "laboris"]
    rows = [(i, f"{calm[i % 10]} {calm[i % 7]}. {'snorkface' if i % 4 == 0 else calm[i % 3]} {calm[i % 9]}.") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0) if i % 80 else 0, 1) for i in range(400)], "doc_id long, toxic int, y int")
    model = fit_toxicity(docs_of(rows).withColumn("y", F.lit(7)).withColumn("__x", F.lit(0)), labels)
    got = {r.doc_id: r.toxicity for r in score_toxicity(docs_of([(1, "amet snorkface"), (2, "amet dolor"), (2, "amet dolor")]), model).collect()}
    assert got[1] >= 0.7 > 0.3 > got[2]


def test_toxicity(spark, docs_of):
    insults, calm = ["snorkface", "blugwit"], ["lorem", "ipsum", "dolor", "amet", "tempor", "magna", "aliqua", "veniam"]
    rows = [(i, " ".join([*calm[i % 5 :], insults[i % 2] if i % 3 == 0 else "quis", *calm[: i % 4]])) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(120)] + [(None, 1, 0), (5, None, 0)], "doc_id long, toxic int, text int")
    model = fit_toxicity(docs_of(rows), labels)
    tests = [(1, "lorem snorkface ipsum"), (2, "amet veniam"), (3, "you s.n.o.r.k.f.a.c.e you"), (4, None), (5, ""), (6, "lorem " * 50000 + "blugwit"), (7, "bl*ugwit")]
    got = {r.doc_id: r.toxicity for r in score_toxicity(docs_of(tests), model).collect()}
    assert min(got[1], got[6], got[7]) >= 0.7 > max(got[2], got[4], got[5]) and got[3] > got[2]
    assert score_toxicity(docs_of([]), model).count() == 0


@pytest.fixture(scope="module")
def trees():
    return he.fit_extractor()


def test_extraction_of_pages_written_by_hand(spark, trees):
    from html_cases import CASES

    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(CASES)], "page_id long, html string")
    got = {r.page_id: r.text.split("\n\n") for r in he.extract_main_text(df, trees).collect()}
    found = sum(b in got[i] for i, (_, blocks) in enumerate(CASES) for b in blocks)
    assert found / sum(len(b) for _, b in CASES) >= 0.98  # recall
    assert found / sum(map(len, got.values())) >= 0.98  # precision
    for i in range(7):  # links in a sentence, lists of links, classes within a line, short titles, bylines, plain asides
        assert got[i] == CASES[i][1]


def test_extraction_of_hidden_parts(spark, trees):
    page = "<article><p>One two three four five six seven eight, and so on.</p><p hidden>no</p><p>Nine <b style='display: none'>no</b> ten <i data-hidden-x=1 class=menu>eleven</i> twelve.</p></article>"
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert he.extract_main_text(df, trees).first().text.split("\n\n") == ["One two three four five six seven eight, and so on.", "Nine ten eleven twelve."]


def test_extraction(spark, sf_dir, trees):
    held = [he._Layout(900_000_000 + k) for k in range(60)]
    right = []
    for layout in held:
        page = he.parse(layout.page())
        right.append(np.mean(np.array(he.decode(page, trees.log_odds(he.features(page)))) == np.array(layout.labels, bool)))
    assert np.mean(right) > 0.98
    rows = [(1, None), (2, ""), (3, "bare &amp; text"), (4, "<p>one <b>two<p>three&nbsp;&lt;"), (5, "<div class='ad'>buy</div><script>x</script>")]
    df = spark.createDataFrame([(i, h, "u", "old") for i, h in rows], "page_id long, html string, url string, text string")
    got = {r.page_id: r.text for r in he.extract_main_text(df, trees).collect()}
    assert got[1] == got[2] == "" and got[3] == "bare & text"
    rows = [
        ("<p>first line<br>second line<br/>third</p>", "first line second line third"), ("<html><body><p>Short note.</p></body></html>", "Short note."),
        ("<html><body>One line.<br>\nAnother line.<br><br>The last.</body></html>", "One line. Another line. The last."),
        ("<body><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be even.</p><p>Then it is two.</p></body>", "Let x=2 be even.\n\nThen it is two."),
        ("<html><body><table><tr><td><a href=/a>Home</a><br><a href=/b>News</a><br><a href=/c>Mail</a><br><a href=/d>Links</a></td><td><h1>Old times</h1>It was a long way to the village, and nobody knew it.<br><br>"
         "They went there on foot, all the same, and came back late.<p>The next day it rained from morning to night, so they stayed at home.</td></tr></table></body></html>",
         "Old times\n\nIt was a long way to the village, and nobody knew it. They went there on foot, all the same, and came back late.\n\nThe next day it rained from morning to night, so they stayed at home."),
        ("<div>" * 3000 + "deep text that goes on for a while" + "</div>" * 3000, "deep text that goes on for a while"),
        ("<p>" + "very long words here. " * 40000 + "</p>", ("very long words here. " * 40000).strip()),
    ]
    bare = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(rows + rows[:2])], "page_id long, html string")
    got = {r.page_id: r.text for r in he.extract_main_text(bare, trees).collect()}
    assert got == {i: t for i, (_, t) in enumerate(rows + rows[:2])}
    assert he.extract_main_text(df.limit(0), trees).count() == 0
    pages = q.table(spark, sf_dir, "pages")
    for r in he.extract_main_text(pages, trees).collect():
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1])
        texts = [re.sub(r"[\x20\x09-\x0D]+", " ", he.html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in blocks]
        assert r.text == "\n\n".join(t for t in texts if t)


def small_layout():
    """A layout of 1024 frequent words, dealt to the classes that are no single words in turn."""
    class_of = np.full(lm.CODES + 1, lm.CLASSES, dtype=np.uint8)
    class_of[: lm.FREQUENT] = [i if i < lm.SINGLES else lm.SINGLES + i % (lm.CLASSES - lm.SINGLES - 1) for i in range(lm.FREQUENT)]
    class_of[lm.FREQUENT : lm.CODES] = np.arange(lm.CLASSES)
    return lm.Layout.of(class_of)


def some_codes(rng, n):
    return np.append(rng.integers(1, lm.CODES, n - 1), 0).astype(np.uint16)


def test_gradients():
    rng, layout = np.random.default_rng(0), small_layout()
    p = {k: rng.standard_normal(s) * 0.3 for k, s in lm.SHAPES.items()}
    docs = [some_codes(rng, n) for n in (5, 3, 7)]
    entry, target = lm.Lanes(docs, 2).window(0, 9)
    h = np.zeros((2, lm.HIDDEN))
    g, _ = lm._window_gradients(p, layout, entry, target, h)

    def loss():
        real = np.flatnonzero((target != lm.PAD).ravel())
        return -lm._output(p, layout, lm._forward(p, entry, h)[0].reshape(-1, lm.HIDDEN)[real], target.ravel()[real])[0].mean()

    word = int(next(c for c in docs[0] if lm.SINGLES <= c < lm.FREQUENT))
    place = int(layout.starts[layout.class_of[word]] + layout.slot_of[word])
    for k, at in (("wh", (3, 5)), ("wo", (2, 7)), ("wx", (int(docs[0][0]), 30)), ("b", (60,)), ("ow", (place, 3)), ("ob", (place,))):
        old = p[k][at]
        p[k][at] = old + 1e-4
        up = loss()
        p[k][at] = old - 1e-4
        down = loss()
        p[k][at] = old
        assert g[k][at] != 0 and (up - down) / 2e-4 == pytest.approx(g[k][at], abs=1e-6), k


def plain_log(p, layout, doc):
    """The log10 probability of a sequence, word by word, with nothing but vectors."""
    h, before, total = np.zeros(lm.HIDDEN), 0, 0.0
    n = lm.HIDDEN
    for code in map(int, doc):
        x, u = p["wx"][before].astype(float) + p["b"], h @ p["wh"]
        z, r = (1 / (1 + np.exp(-(x[i * n : i * n + n] + u[i * n : i * n + n]))) for i in (0, 1))
        cand = np.tanh(x[2 * n :] + r * u[2 * n :])
        h = z * h + (1 - z) * cand
        c = int(layout.class_of[code])
        logits = h @ p["wo"] + p["bo"]
        total += logits[c] - np.log(np.exp(logits).sum())
        if c >= lm.SINGLES:
            a, b = layout.starts[c], layout.starts[c + 1]
            inner = p["ow"][a:b] @ h + p["ob"][a:b]
            total += inner[layout.slot_of[code]] - np.log(np.exp(inner).sum())
        before = code
    return total / np.log(10)


def test_sequences_against_a_plain_forward_pass():
    rng, layout = np.random.default_rng(1), small_layout()
    p = {k: (rng.standard_normal(s) * 0.3).astype(np.float32) for k, s in lm.SHAPES.items()}
    docs = [some_codes(rng, n) for n in (200, 1, 3, 90, 64, 65)]
    assert lm.sequence_logs(p, layout, docs) == pytest.approx([plain_log(p, layout, d) for d in docs], rel=1e-4)


def test_shares_sum_to_one(spark, docs_of):
    """The model's probabilities of the first word of a text, over all known words, the end and one unknown word of each class, sum to 1."""
    rows = [(i, f"alpha beta{i} gamma delta{i % 7} {'omega ' * (i % 3)}") for i in range(60)]
    found = lm.build_vocabulary(lm.word_counts(docs_of(rows)))
    p, counts = lm.initial(found), Counter(w for _, t in rows for w in [*t.split(), ""])
    total, seen = 0.0, set()
    for w, c in counts.items():
        code = 0 if not w else int(found.encode([w.encode()])[0][0])
        h = lm._forward(p, np.zeros((1, 1), dtype=np.int64), np.zeros((1, lm.HIDDEN), dtype=np.float32))[0][0]
        share = np.exp(lm._output(p, found.layout, h, np.array([code]))[0][0])
        total += share * ((c + 0.5) / 10 ** found.other_log[code - lm.FREQUENT] if code >= lm.FREQUENT else 1.0)
    for k in range(lm.CLASSES):
        h = lm._forward(p, np.zeros((1, 1), dtype=np.int64), np.zeros((1, lm.HIDDEN), dtype=np.float32))[0][0]
        if k >= lm.SINGLES:
            total += np.exp(lm._output(p, found.layout, h, np.array([lm.FREQUENT + k]))[0][0]) * 0.5 / 10 ** found.other_log[k]
        elif k not in found.layout.class_of[: lm.FREQUENT]:
            seen.add(k)  # a single class without a word
            total += np.exp(lm._output(p, found.layout, h, np.array([lm.FREQUENT + k]))[0][0])
    assert total == pytest.approx(1.0, abs=1e-3)


def test_lm_scores(spark, docs_of, sf_dir):
    for rows in ([(1, None), (2, ""), (3, "A a B"), (4, "a a"), (5, "É é"), (6, "c " * 30000), (4, "a a"), (11, "zz")], [(r["doc_id"], r["text"]) for r in q.table(spark, sf_dir, "documents").collect()]):
        tokens = [(str(d), (t or "").encode().lower().split() + [b""]) for d, t in rows]
        c = Counter(w for d, ws in tokens if zlib.crc32(d.encode()) % 5 != 1 for w in ws)
        n, v = sum(c.values()), len(c)
        want = Counter((int(d), len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 3)) for d, ws in tokens)
        got = lm.score_documents(docs_of(rows), q.held_out(1, 5)).collect()
        assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 3)) for r in got) == want
        assert all(r.train_tokens == n and r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_trains_on_every_text(spark, docs_of, monkeypatch):
    rows = [(i, f"alpha beta number{i} gamma") for i in range(6)]
    for row in rows:
        one = docs_of([row]).select("doc_id", F.lit(False).alias("held_out"), "text")
        found = lm.build_vocabulary(lm.word_counts(one))
        shared, start = spark.sparkContext.broadcast(found), lm.initial(found)
        after = lm.train_recurrent(lm.encode_documents(one, shared), shared, start)
        assert np.abs(lm.flat(after) - lm.flat(start)).max() > 0, row
    monkeypatch.setattr(lm, "GROUP_WORDS", 500)
    monkeypatch.setattr(lm, "SLICE_BYTES", 300)
    rows = [(i, LONG) for i in range(100)] + [(None, "a b"), (200, None), (201, ""), (202, " x\ty  X ")]
    copies = docs_of(rows).select("doc_id", F.lit(False).alias("held_out"), lm.text_of().alias("text"))
    found = lm.build_vocabulary(lm.word_counts(copies))
    dealt = lm.encode_documents(copies, spark.sparkContext.broadcast(found)).collect()
    sizes = Counter()
    for r in dealt:
        sizes[r.g] += len(r.codes) // 2
        assert r.round == r.g % lm.ROUNDS and len(r.codes) == 2 * (r.words + 1) and r.codes[-2:] == b"\0\0"
    assert Counter((r.doc_id, r.words) for r in dealt) == Counter((d, len((t or "").split())) for d, t in rows)
    assert len(dealt) == 104 and sum(sizes.values()) == found.tokens == 100 * 41 + 3 + 1 + 1 + 4
    assert len(sizes) == 8 and max(sizes.values()) < 1200


def test_lm_trains_in_even_lanes(monkeypatch):
    """Each word is a target once, after the word before it, and a long text doesn't leave the other lanes idle."""
    rng, layout = np.random.default_rng(2), small_layout()
    docs = [some_codes(rng, n) for n in (9000, *rng.integers(1, 40, 500))]
    stream, seen, windows = np.concatenate(docs).tolist(), Counter(), 0
    gradients = lm._window_gradients

    def watched(p, layout, entry, target, h):
        nonlocal windows
        windows += 1
        seen.update((int(a), int(b)) for a, b in zip(entry.ravel(), target.ravel(), strict=True) if b != lm.PAD)
        return gradients(p, layout, entry, target, h)

    monkeypatch.setattr(lm, "_window_gradients", watched)
    start = np.concatenate([(rng.standard_normal(s) * 0.1).ravel() for s in lm.SHAPES.values()]).astype(np.float32)
    after = lm.train_group(start, layout, docs, 0.01)
    assert np.isfinite(after).all() and np.abs(after - start).max() > 0
    assert seen == Counter(zip([0, *stream], stream, strict=False))
    lanes = len(stream) // (lm.WINDOW * lm.WINDOWS)
    assert lanes > 5 and windows == math.ceil(math.ceil(len(stream) / lanes) / lm.WINDOW)


def test_lm_logits_of_a_word(spark, sf_dir):
    """The softmax of the classes and that within a class together are far from the frequent words' number, no class of all the rest among them."""
    found = lm.build_vocabulary(lm.word_counts(q.table(spark, sf_dir, "documents").select(lm.text_of().alias("text"))))
    places = np.diff(found.layout.starts)[np.minimum(found.layout.class_of[: lm.CODES], lm.CLASSES - 1)]
    assert lm.CLASSES + (found.code_words * places).sum() / found.code_words.sum() < 130


def test_lm_codes(spark, docs_of):
    words = [*(f"{a}{b}{c}" for a in "xyz" for b in "abcdeé" for c in "fghijklü"), *"abcdefg", "日本"]
    rows = [(i, " ".join(w for k, w in enumerate(words) if i % (k + 1) == 0)) for i in range(1, 400)]
    counts = Counter(w.encode() for _, t in rows for w in t.split())
    found = lm.build_vocabulary(lm.word_counts(docs_of(rows)))
    by_rank = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    rest = Counter()
    for w in by_rank[lm.SINGLES - 1 :]:
        rest[w[-2:]] += counts[w]
    endings = [e for e, _ in sorted(rest.items(), key=lambda x: (-x[1], x[0]))][: lm.ENDINGS]
    assert len(rest) > lm.ENDINGS

    def class_of(w):
        return lm.SINGLES + (endings.index(w[-2:]) if w[-2:] in endings else lm.ENDINGS + w[-1] % lm.RESTS)

    asked = [*by_rank, b"q", b"qq", "ß".encode(), b"qab"]
    want = [*range(1, len(by_rank) + 1), *(lm.FREQUENT + class_of(w) for w in asked[len(by_rank) :])]
    for given, n in ((asked, 0), (pa.array([b"zz", b"", *asked], pa.binary())[2:], 0), (pa.array([b"", *asked], pa.binary()), 1)):
        codes, at = found.encode(given)
        assert codes[n:].tolist() == want and at[n:].tolist() == [*range(1, len(by_rank) + 1), -1, -1, -1, -1]
        assert (at[:n] == -1).all()
    assert [int(found.layout.class_of[i]) for i in range(1, len(by_rank) + 1)] == [i if i < lm.SINGLES else class_of(w) for i, w in enumerate(by_rank, 1)]
    assert found.code_words.sum() == found.tokens == sum(counts.values()) + len(rows)


def test_lm_on_an_empty_table(docs_of):
    assert lm.score_documents(docs_of([]), q.held_out(1, 5)).count() == 0


def test_pipeline(spark, sf_dir):
    docs = q.table(spark, sf_dir, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    stages = dict(corpus_pipeline.STAGES)
    calm = stages["toxicity"](spark, docs, sf_dir)
    assert calm.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in calm.collect()]
    one = {c for _, c, _ in brute_join(rows)}
    single = stages["near_duplicates"](spark, calm, sf_dir)
    assert {r.doc_id for r in single.collect()} == one
    clean = stages["decontamination"](spark, single, sf_dir)
    bench = [re.findall(r"\w+", r.text.lower()) for r in q.table(spark, sf_dir, "benchmark").collect()]
    texts = {r.doc_id: " ".join(re.findall(r"\w+", r.text.lower())) for r in single.collect()}
    assert {r.doc_id for r in clean.collect()} <= {d for d, t in texts.items() if not any(" ".join(b) in t for b in bench)}
    sharded = corpus_pipeline.run(spark, sf_dir)
    counts = Counter(r.shard for r in sharded.collect())
    assert len(counts) == 40 and max(counts.values()) - min(counts.values()) <= 1


def test_pipeline_of_odd_rows(spark, docs_of, sf_dir, tmp_path):
    """Every stage keeps rows with nulls, empty, repeated and very long texts, and columns of clashing names, and an empty table."""
    odd = [(1, None), (2, ""), (None, "no id but some words"), (4, LONG, None), (4, LONG, None), (5, "wörd " * 60000), (6, "the last of them all is short")]
    for rows in (odd, []):
        docs = docs_of(rows).withColumn("toxicity", F.lit("t")).withColumn("row_hash", F.lit(1)).withColumn("__key", F.lit("k"))
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, sf_dir)
            columns = docs.columns + ["slot"] if name == "sharding" else docs.columns
            assert sorted(found.columns) == sorted(columns), name
            path = f"file://{tmp_path}/{name}-{len(rows)}"
            found.write.parquet(path)
            docs = spark.read.parquet(path)
        got = docs.collect()
        assert {r.doc_id for r in got} >= ({1, 2} if rows else set()) and (rows or not got)


def test_links_of_every_twentieth_id(spark):
    """Recall of the join at a larger scale: rows whose id is divisible by 20 against all rows, by brute force."""
    docs = q.table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = gram_sets(rows)
    links = {}
    for i, (d, _) in enumerate(rows):
        if d % 20 == 0:
            links[d] = sum(1 for j, s in enumerate(sets) if j != i and sets[i] and len(sets[i] & s) >= 0.8 * len(sets[i] | s) - 1e-9 and sets[i] & s)
    got = {r.doc_id: r.n_links for r in ngram_join(docs).where("doc_id % 20 = 0").collect()}
    assert got == links and sum(links.values()) > 0
