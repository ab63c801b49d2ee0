"""Rules documents (JSON, or YAML where a parser is installed) as checked relations; every fault is reported, none repaired."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import content_hash

try:
    import yaml
except ImportError:  # optional
    yaml = None

# Limits of a rules document and the version of its format.
MAX_BYTES, MAX_RULES, MAX_ENTRIES, MAX_JUDGMENT = 256 * 1024, 500, 100, 4000
CATEGORIES = (2, 20)
FORMAT_VERSION = 1
FIELDS = ("from", "domain", "phrase")
PLACES = ("subject", "body", "any")


def parsed_document(text: str) -> tuple[object, list[str]]:
    """(document, faults): a document over MAX_BYTES or that cannot be read has a fault, and is None."""
    if len(text.encode()) > MAX_BYTES:
        return None, [f"the document is over {MAX_BYTES} bytes"]
    try:
        return json.loads(text), []
    except ValueError as fault:
        if yaml is None:
            return None, [f"the document is no JSON: {fault}"]
    try:
        if text.count("*") > 50:
            return None, ["the document has too many aliases"]
        return yaml.safe_load(text), []
    except yaml.YAMLError as fault:
        return None, [f"the document cannot be read: {fault}"]


def document_faults(document: object) -> list[str]:
    """All faults of a rules document {"version", "categories": [{"name", "description"}], "judgment": [...], "rules": [...]}, in its order."""
    if not isinstance(document, dict):
        return ["the document is no object"]
    faults = [f"{k}: unknown key" for k in document if k not in ("version", "categories", "judgment", "rules")]
    categories = document.get("categories") or []
    if not CATEGORIES[0] <= len(categories) <= CATEGORIES[1]:
        faults.append(f"categories: {CATEGORIES[0]} to {CATEGORIES[1]} are needed")
    seen: dict[str, int] = {}
    for i, c in enumerate(categories):
        first = seen.setdefault(str(c.get("name", "")).lower(), i)
        if first != i:
            faults.append(f"categories[{i}]: the name of categories[{first}]")
    if sum(len(str(line).strip()) for line in document.get("judgment") or []) > MAX_JUDGMENT:
        faults.append(f"judgment: over {MAX_JUDGMENT} characters")
    rules = document.get("rules") or []
    if len(rules) > MAX_RULES:
        faults.append(f"rules: over {MAX_RULES}")
    for i, rule in enumerate(rules):
        wanted = rule.get("match") or {}
        lists = {f: wanted.get(f) or [] for f in FIELDS}
        faults += [f"rules[{i}].match.{f}: over {MAX_ENTRIES} entries" for f, entries in lists.items() if len(entries) > MAX_ENTRIES]
        if not any(lists.values()):
            faults.append(f"rules[{i}].match: no entry")
        if "in" in wanted and (not lists["phrase"] or wanted["in"] not in PLACES):
            faults.append(f"rules[{i}].match.in: needs a phrase, and is one of {', '.join(PLACES)}")
        if str(rule.get("label", "")).lower() not in seen:
            faults.append(f"rules[{i}].label: no category")
    return faults


def normalised_rule(rule: dict) -> dict:
    """A rule as it is compared: addresses and domains in lower case, no dot at a domain's end, spaces of phrases folded, the place filled in."""
    wanted = rule["match"]
    match: dict = {}
    if wanted.get("from"):
        match["from"] = [x.strip().lower() for x in wanted["from"]]
    if wanted.get("domain"):
        match["domain"] = [x.strip().lower().rstrip(".") for x in wanted["domain"]]
    if wanted.get("phrase"):
        match |= {"phrase": [" ".join(x.split()) for x in wanted["phrase"]], "in": wanted.get("in", "any")}
    return {"match": match, "label": rule["label"]}


def rule_documents(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(source, rule, field, entry, place, label, fault) of a few documents: a row for each entry, or for each fault of a document that has any."""
    rows = []
    for source, text in enumerate(texts):
        document, faults = parsed_document(text)
        faults = faults or document_faults(document)
        rows += [(source, None, None, None, None, None, x) for x in faults]
        for i, rule in enumerate([] if faults else document.get("rules") or []):
            match = normalised_rule(rule)["match"]
            rows += [(source, i, f, e, match.get("in") if f == "phrase" else None, rule["label"], None) for f in FIELDS for e in match.get(f, [])]
    return spark.createDataFrame(rows, "source int, rule int, field string, entry string, place string, label string, fault string")


def rule_set_text(document: dict) -> str:
    """The canonical text of a rules document: what does not change its meaning does not change it."""
    rules = {**document, "rules": [normalised_rule(r) for r in document.get("rules") or []]}
    return json.dumps({"format_version": FORMAT_VERSION, "rules": rules}, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def rule_set_hash(text: Column) -> Column:
    return content_hash(text)


def duplicate_index(df: DataFrame, name: str, order: str) -> DataFrame:
    """(order, name, first): rows whose name, whatever its case, occurs before, and where it occurs first."""
    firsts = df.groupBy(F.lower(F.trim(name)).alias("__name")).agg(F.min(order).alias("first"))
    return df.join(firsts, F.lower(F.trim(name)) == F.col("__name")).where(F.col(order) != F.col("first")).select(order, name, "first")
