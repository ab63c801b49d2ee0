"""Secret scans: three fixed patterns and a battery of randomness tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_of, unused

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Kinds in the order in which spans that begin together are listed.
KINDS = ("assign", "access", "hex", "random")
#: A token that the randomness tests look at: at least 20 characters, too few of which tell nothing.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])"


#: Pieces that are folded into one array of spans; no array that grows with the text is copied at each of its spans.
SLICE = 64
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,token:string>"


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once: as the variable of a lambda, however often it stands in what ``use`` gives."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans_of(text: Column, pattern: str, kind: str, hint: str, accept, groups: int = 0) -> Column:
    """array<struct<start, rank, end, kind, token>> of the leftmost non-overlapping matches.

    Each match of ``(.*?)(pattern)`` is the gap before a match and the match; lengths add up to
    offsets in code points. They are added up within slices of SLICE pieces, then the slices' own offsets are added, so
    that the work is linear in the text. Rows without a match of ``hint`` are not split.
    """
    split = rf"(?s)(.*?)(?:({pattern})|\z)"
    gaps = F.regexp_extract_all(text, F.lit(split), F.lit(1))
    hits = F.regexp_extract_all(text, F.lit(split), F.lit(2))
    values = F.regexp_extract_all(text, F.lit(split), F.lit(3)) if groups else hits
    none = F.array().cast(f"array<{SPAN}>")
    zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("found"))

    def span(start, end, token):
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), token.alias("token"))

    def step(state, x):
        start = state["at"] + F.length(x["gaps"])
        end = start + F.length(x["hits"])
        found = F.when(accept(x["hits"], x["values"]), F.concat(state["found"], F.array(span(start, end, x["hits"])))).otherwise(state["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    def sliced(pieces):
        return F.transform(F.sequence(F.lit(1), F.size(pieces), F.lit(SLICE)), lambda k: F.aggregate(F.slice(pieces, k, SLICE), zero, step))

    def placed(parts):
        ends = F.aggregate(parts, F.array(F.lit(0).cast("long")), lambda ends, x: F.concat(ends, F.array(F.element_at(ends, -1) + x["at"])))
        moved = lambda base: F.transform(parts, lambda x, i: F.transform(x["found"], lambda s: span(s["start"] + base[i], s["end"] + base[i], s["token"])))
        return F.flatten(_bound(ends, moved))

    pieces = F.arrays_zip(gaps.alias("gaps"), hits.alias("hits"), values.alias("values"))
    return F.when(text.rlike(hint), _bound(_bound(pieces, sliced), placed)).otherwise(none)


def normal_below(z: Column) -> Column:
    """The standard normal distribution, after Abramowitz and Stegun 26.2.17."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * t * (
        0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))
    )
    return F.when(z < 0, tail).otherwise(1 - tail)


#: Encodings in the order in which they are inferred, by the size of their alphabet: the letters, and ordinary text against
#: which a token is tested: how far its letters are from uniform (the expected chi-squared is that of uniform letters
#: plus this much for each character), and how often the kind of character (digit, upper, lower; separators left out)
#: changes from one to the next. Words joined by capitals change more often than others: those of the Python standard
#: library and of the packages installed here have a median excess of 1.41 and 0.29 changes, words joined by separators
#: 2.79 and 0.0 (3928 and 49,427 tokens).
ENCODINGS = {
    16: (r"^(?:[0-9a-f]+|[0-9A-F]+)$", 0.9, 0.12),
    26: (r"^(?:[a-z]+|[A-Z]+)$", 0.72, 0.12),
    32: (r"^[A-Z2-7]+=*$", 1.2, 0.12),
    36: (r"^(?:[a-z0-9]+|[A-Z0-9]+)$", 1.4, 0.12),
    52: (r"^[A-Za-z]+$", 1.4, 0.29),
    62: (r"^[A-Za-z0-9]+$", 2.4, 0.2),
    64: (r"", 2.8, 0.2),
}
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most lag-1 correlation, in standard errors, that still counts as random.
SERIAL_LIMIT = 3.3


#: Sums over the codes of a token: of codes, of squares, of products of neighbours; the first and the last code.
NO_SUMS = {"sum": 0.0, "squares": 0.0, "products": 0.0, "first": -1.0, "last": -1.0}


def _add_code(sums: Column, char: Column) -> Column:
    code = F.ascii(char).cast("double")
    return F.struct(
        (sums["sum"] + code).alias("sum"),
        (sums["squares"] + code * code).alias("squares"),
        (sums["products"] + F.when(sums["last"] < 0, F.lit(0.0)).otherwise(sums["last"] * code)).alias("products"),
        F.when(sums["first"] < 0, code).otherwise(sums["first"]).alias("first"),
        code.alias("last"),
    )


def _serial_correlation(sums: Column, n: Column) -> Column:
    """The lag-1 correlation in standard errors, from the sums of one pass: linear in the length of the token."""
    mean = sums["sum"] / n
    variance = sums["squares"] - sums["sum"] * mean
    lagged = sums["products"] - mean * (2 * sums["sum"] - sums["first"] - sums["last"]) + (n - 1) * mean * mean
    return F.abs(lagged / F.greatest(variance, F.lit(1e-9))) * F.sqrt(n)


def _counted(token: Column) -> Column:
    """What the tests need of a token, each value worked out once: n, size, excess and often (of its encoding), squares, kinds, serial."""
    n = F.length(token)
    chars = F.split(token, "")
    found = F.lit(None)
    for letters, (pattern, more, often) in reversed(ENCODINGS.items()):
        values = F.struct(F.lit(letters).alias("size"), F.lit(more).alias("excess"), F.lit(often).alias("often"))
        found = F.when(token.rlike(pattern), values).otherwise(found) if pattern else values
    squares = F.aggregate(
        F.array_distinct(chars),
        F.lit(0.0),
        lambda s, c: s + F.pow((n - F.length(F.replace(token, c, F.lit("")))).cast("double"), F.lit(2.0)),
    )
    kinds = F.translate(token, DIGITS + UPPER + LOWER + "+/_=-", "0" * 10 + "1" * 26 + "2" * 26)
    serial = F.aggregate(chars, F.struct(*[F.lit(x).alias(k) for k, x in NO_SUMS.items()]), _add_code, lambda s: _serial_correlation(s, n))
    return F.struct(n.alias("n"), found.alias("code"), squares.alias("squares"), kinds.alias("kinds"), serial.alias("serial"))


def _deviations(t: Column) -> Column:
    """How far the letters are from what ordinary text has, and how much more often their kinds change, in standard deviations."""
    n, size, often = t["n"], t["code"]["size"], t["code"]["often"]
    excess = n * t["code"]["excess"]
    steps = F.greatest(F.length(t["kinds"]) - 1, F.lit(1))
    changes = F.regexp_count(t["kinds"], F.lit(r"0(?=[12])|1(?=[02])|2(?=[01])"))
    return F.struct(
        n.alias("n"),
        ((t["squares"] * size / n - n - (size - 1) - excess) / F.sqrt(2 * (size - 1) + 4 * excess)).alias("letters"),
        ((changes - 0.5 - steps * often) / F.sqrt(steps * often * (1 - often))).alias("runs"),
        t["kinds"].rlike("^(?:0*|1*|2*)$").alias("one_kind"),
        (t["serial"] > SERIAL_LIMIT).alias("serial"),
    )


def _p_values(t: Column) -> Column:
    return F.struct(t["n"].alias("n"), normal_below(t["letters"]).alias("p_chi"), (1 - normal_below(t["runs"])).alias("p_runs"), t["one_kind"].alias("one_kind"), t["serial"].alias("serial"))


def _combined(t: Column) -> Column:
    """Fisher's combination of the two p-values; a token of one kind of character has no changes to count, whatever it is."""
    product = F.greatest(t["p_chi"] * t["p_runs"], F.lit(1e-300))
    p = F.when(t["serial"], F.lit(1.0)).when(t["one_kind"], t["p_chi"]).otherwise(product * (1 - F.log(product)))
    return F.struct(p.alias("p"), _stratum(t["n"]).alias("stratum"))


def randomness(tokens: Column) -> Column:
    """For an array of tokens an array of struct<p, stratum, bin>: how likely ordinary text looks as random as the token, its class of length, the place of p in the histogram."""
    found = F.transform(F.transform(F.transform(F.transform(tokens, _counted), _deviations), _p_values), _combined)
    place = lambda r: F.floor(-F.log10(F.greatest(r["p"], F.lit(1e-300))) * BINS).cast("int")
    return F.transform(found, lambda r: F.struct(r["p"].alias("p"), r["stratum"].alias("stratum"), place(r).alias("bin")))


#: Least lengths of the classes of length; in each the false discoveries are controlled by themselves.
LENGTHS = (20, 24, 32, 48, 96)
#: Bins of the histogram of p, to a power of ten.
BINS = 16


def _stratum(n: Column) -> Column:
    return sum(((n >= least).cast("int") for least in LENGTHS[1:]), F.lit(0))


def discovery_cuts(tested: DataFrame, level: float, column: str = "__tested") -> dict[int, int]:
    """For each class of length the lowest bin of p that passes a Benjamini-Hochberg cut at ``level`` over all tokens of the corpus.

    ``tested`` has an array ``column`` of randomness results. Tokens are counted by class and bin, each
    bin taken at its highest p, so that no list of p-values is sorted and the driver gets a row for
    each class at most. A class in which nothing passes is left out.
    """
    counts = tested.select(F.explode(f"{column}.r").alias("r")).groupBy("r.stratum", "r.bin").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("stratum")
    from_here = whole.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    found = F.pow(F.lit(10.0), -F.col("bin") / BINS) * F.sum("n").over(whole) / F.sum("n").over(from_here)
    passing = counts.withColumn("q", found).where(F.col("q") <= level)
    return {r["stratum"]: r["bin"] for r in passing.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}


def with_tests(df: DataFrame, tokens: str = "__tokens", tested: str = "__tested") -> DataFrame:
    """``df`` with ``tested``: each of its ``tokens`` with the result of the battery."""
    results = randomness(F.transform(tokens, lambda s: s["token"]))
    return df.withColumn(tested, F.zip_with(tokens, results, lambda s, r: F.struct(s.alias("span"), r.alias("r")))).drop(tokens)


def joined(spans: Column) -> Column:
    ordered = F.array_sort(spans)
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan_secrets(docs: DataFrame, text_col: str = "text", level: float = 0.01) -> DataFrame:
    """``docs`` with ``base_spans`` and ``random_spans``: arrays of (start, rank, end, kind, token).

    Offsets are in code points, the end exclusive. Base spans are the leftmost non-overlapping
    matches of each pattern, those that fail its length test dropped after matching. Random spans are
    tokens of at least 20 characters that the randomness battery finds: for an inferred encoding (see
    ENCODINGS), how close the letters are to uniform (chi-squared) and how often the kind of character
    changes (runs), each against ordinary text, with a limit on serial correlation; Fisher's combination of
    the two p-values passes a Benjamini-Hochberg cut at ``level`` over the tokens of like length of the
    whole corpus, found in a pass of its own. A random span may cover a base span: the battery looks at
    every token by itself. Short tokens of a small alphabet, most of all letters of one case, tell too
    little to be found for sure.

    Null text counts as empty and has no spans. Repeated rows give equal results, an empty table an
    empty one; columns named base_spans or random_spans are replaced.
    """
    text = text_of(text_col)
    docs = docs.drop("base_spans", "random_spans")
    c_assign, c_access, c_hex, c_tokens, c_tested = unused(docs, "__assign", "__access", "__hex", "__tokens", "__tested")
    tokens = spans_of(text, TOKEN, "random", TOKEN, lambda hit, _: F.length(hit) > 0)
    cuts = discovery_cuts(with_tests(docs.select(tokens.alias(c_tokens)), c_tokens, c_tested), level, c_tested)
    found = docs.withColumns(
        {
            c_assign: spans_of(text, ASSIGN, "assign", ASSIGN, lambda hit, value: F.length(value) >= 6, groups=1),
            c_access: spans_of(text, ACCESS, "access", ACCESS, lambda hit, _: F.length(hit) >= 20),
            c_hex: spans_of(text, HEX, "hex", "[0-9a-f]{24}", lambda hit, _: F.length(hit) >= 24),
            c_tokens: tokens,
        }
    )
    with_base = found.withColumn("base_spans", F.concat(c_assign, c_access, c_hex)).drop(c_assign, c_access, c_hex)
    never = F.lit(1 << 30)
    cut = F.array(*[F.lit(cuts[k]) if k in cuts else never for k in range(len(LENGTHS))])
    passed = F.filter(c_tested, lambda t: t["r"]["bin"] >= F.get(cut, t["r"]["stratum"]))
    return with_tests(with_base, c_tokens, c_tested).withColumn("random_spans", F.transform(passed, lambda t: t["span"])).drop(c_tested)


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan_secrets(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))

    def count(kind):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"),
        joined(F.concat("base_spans", "random_spans")).alias("spans"),
    )
