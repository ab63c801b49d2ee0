"""Owner-written exact rules, matched as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalise
from .phrases import FEW, phrase_rules

#: One row for each entry of a rule: its place, the field it looks at, the entry and the label that the rule gives.
ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("rule", T.IntegerType(), False),
        T.StructField("field", T.StringType(), False),  # from, domain or phrase
        T.StructField("place", T.StringType(), True),  # of a phrase: subject, body or any
        T.StructField("entry", T.StringType(), False),
        T.StructField("label", T.StringType(), False),
    ]
)
#: Rules are checked on load to be at most so many, with so many entries each; so they may be broadcast.
MAX_RULES, MAX_ENTRIES = 500, 100


def rule_entries(spark, rules: list[dict]) -> DataFrame:
    """Checked rules as entries; phrases are normalised as texts are. A rule is {"match": {"from": [...], "domain": [...], "phrase": [...], "in": "any"}, "label": ...}."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rows = []
    for i, rule in enumerate(rules):
        wanted = rule["match"]
        entries = [(f, e) for f in ("from", "domain", "phrase") for e in wanted.get(f, [])]
        if not entries or any(len(wanted.get(f, [])) > MAX_ENTRIES for f in ("from", "domain", "phrase")):
            raise ValueError(f"rule {i} has no entry, or a list of over {MAX_ENTRIES}")
        if "in" in wanted and not wanted.get("phrase"):
            raise ValueError(f"rule {i}: 'in' needs a phrase")
        for f, e in entries:
            rows.append((i, f, wanted.get("in", "any") if f == "phrase" else None, e if f == "phrase" else e.lower().rstrip(".") if f == "domain" else e.lower(), rule["label"]))
    entries = spark.createDataFrame(rows, ENTRY_SCHEMA)
    plain = all(r[3].isascii() for r in rows)
    return entries.withColumn("entry", F.when(F.col("field") == "phrase", normalise(F.col("entry"), plain)).otherwise(F.col("entry")))


def _one_row(entries: DataFrame, with_phrases: bool) -> DataFrame:
    """All entries as one row, bounded by the checks on load: addresses and domains as maps to their rules, few phrases as an array, and each rule's fields and label."""
    by = {f: entries.where(F.col("field") == f) for f in ("from", "domain", "phrase")}
    maps = [by[f].groupBy("entry").agg(F.array_sort(F.collect_set("rule")).alias("r")).agg(F.map_from_entries(F.collect_list(F.struct("entry", "r"))).alias(f"__{f}")) for f in ("from", "domain")]
    phrases = by["phrase"].where("entry <> ''" if with_phrases else "false").agg(F.array_sort(F.collect_list(F.struct("rule", "place", "entry"))).alias("__phrases"))
    totals = entries.groupBy("rule").agg(F.countDistinct("field").cast("int").alias("total"), F.first("label").alias("label"))
    about = totals.agg(F.map_from_entries(F.collect_list(F.struct("rule", F.struct("total", "label")))).alias("__rules"), F.min_by(F.struct("rule", "total"), "rule").alias("__first"))
    return maps[0].crossJoin(maps[1]).crossJoin(phrases).crossJoin(about)


def with_hits(messages: DataFrame, entries: DataFrame) -> DataFrame:
    """``messages`` with ``hits``: an array of (rule, field), once for each field of a rule that some entry meets, and what ``_one_row`` knows of the rules.

    ``messages`` has id, from_address, from_domain, subject and body (normalised). An address is looked
    up in a map; a domain too, by the suffixes of the sender's domain at label boundaries; a phrase is
    literal containment, so no pattern is ever built from data; more than FEW phrases are found in one pass
    (``phrase_rules``). Each message is read once and no row moves.
    """
    listed = entries.where("field = 'phrase' and entry <> ''").select("rule", "place", "entry").limit(MAX_RULES * MAX_ENTRIES + 1).collect()
    many = len(listed) > FEW
    parts = F.split(F.regexp_replace(F.lower("from_domain"), r"\.$", ""), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    none = F.array().cast("array<int>")
    found = lambda table, key: F.coalesce(F.try_element_at(F.col(table), key), none)
    address = found("__from", F.lower("from_address"))
    domain = F.when(F.col("from_domain").isNull(), none).otherwise(F.flatten(F.transform(suffixes, lambda s: found("__domain", s))))
    subject, body = F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit(""))
    in_text = lambda p: ((p["place"] != "body") & F.contains(subject, p["entry"])) | ((p["place"] != "subject") & F.contains(body, p["entry"]))
    phrase = F.col("__phrase_rules") if many else F.transform(F.filter("__phrases", in_text), lambda p: p["rule"])
    read = messages.withColumn("__phrase_rules", phrase_rules(messages.sparkSession, [tuple(r) for r in listed])) if many else messages
    mark = lambda rules, field: F.transform(rules, lambda r: F.struct(r.alias("rule"), F.lit(field).alias("field")))
    hits = F.array_distinct(F.concat(mark(address, "from"), mark(domain, "domain"), mark(phrase, "phrase")))
    return read.crossJoin(F.broadcast(_one_row(entries, not many))).withColumn("hits", hits)


def entry_matches(messages: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, rule, field) once for each field of a rule that some entry meets."""
    return with_hits(messages, entries).select("id", F.explode("hits").alias("h")).select("id", "h.rule", "h.field")


def first_match(messages: DataFrame, entries: DataFrame) -> DataFrame:
    """id, winner, label, nearest_miss, met and total for each message.

    The winner is the first rule all of whose fields are met. Without one, the nearest miss is the
    rule with the highest fraction of fields met, the first among equals, even if it met none; the
    fractions are compared as integers. Everything is decided within a message's row.
    """
    hit = with_hits(messages, entries).select("id", "hits", "__rules", "__first")
    known = lambda r: F.try_element_at(F.col("__rules"), r)
    met = lambda r: F.size(F.filter("hits", lambda h: h["rule"] == r))
    rules = F.array_distinct(F.transform("hits", lambda h: h["rule"]))
    ranked = hit.withColumn("met", F.transform(rules, lambda r: F.struct(r.alias("rule"), met(r).alias("met"), known(r)["total"].alias("total"), known(r)["label"].alias("label"))))
    whole = F.transform(F.filter("met", lambda m: m["met"] == m["total"]), lambda m: F.struct(m["rule"], m["label"]))
    share = lambda m: (m["met"] * 6 / m["total"]).cast("int").alias("share")
    near = F.transform("met", lambda m: F.struct(share(m), (-m["rule"]).alias("order"), m["met"].alias("met"), m["total"].alias("total")))
    best = ranked.select("id", "__first", F.array_min(whole).alias("win"), F.array_max(near).alias("near"))
    won = F.col("win").isNotNull()
    # a message that meets nothing misses the first rule, by nothing of its total
    return best.select(
        "id",
        F.col("win.rule").alias("winner"),
        F.col("win.label").alias("label"),
        F.when(~won, F.coalesce(-F.col("near.order"), F.col("__first.rule"))).alias("nearest_miss"),
        F.when(~won, F.coalesce("near.met", F.lit(0))).alias("met"),
        F.when(~won, F.coalesce("near.total", F.col("__first.total"))).alias("total"),
    )
