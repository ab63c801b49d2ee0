"""Stable identities and content hashes of messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .canonical import canonical
from .text import SPACE, fold_space, strip_nul

# Prefixes and pattern of identity keys.
IDENTITY_PATTERN = r"^(pm:.+|mid:.+|hdr:v[0-9]+:[0-9a-f]{64})$"
#: Fixed value: form of a trusted id.
TRUSTED_PATTERN = r"^[A-Za-z0-9_=-]{1,200}$"


def is_identity(key: Column) -> Column:
    return key.rlike(IDENTITY_PATTERN)


def message_id(raw: Column) -> Column:
    """A Message-ID without its brackets, its domain in lower case; null if empty or over 998 bytes."""
    bare = F.regexp_replace(F.regexp_replace(raw, f"^{SPACE}+|{SPACE}+$", ""), "^<|>$", "")
    domain = F.substring_index(bare, "@", -1)
    local = F.substring(bare, F.lit(1), F.length(bare) - F.length(domain))
    whole = F.when(F.contains(bare, F.lit("@")), F.concat(local, F.lower(domain))).otherwise(bare)
    return F.when((F.length(whole) > 0) & (F.octet_length(whole) <= 998), whole)


def canonical_array(values: list[Column]) -> Column:
    """A JSON array of strings and nulls in canonical form."""
    return canonical(F.array(*[v.cast("string") for v in values]), "array<string>")


def canonical_map(entries: Column) -> Column:
    """A map of strings as canonical JSON; null values are kept."""
    return canonical(entries, "map<string,string>")


#: Fixed value: the headers that stand for a message without an id, in order.
STABLE_HEADERS = ("date", "from", "to", "cc", "subject", "in-reply-to")


def header_hash(headers: Column, size: Column) -> Column:
    """The hash of a message's stable headers, each with its name and all its values, and its size (null if unknown).

    ``headers`` maps names in small letters to arrays of values, not decoded; a header that is absent has none. Values lose NUL, and white space
    at their ends; runs of white space inside become one space.
    """
    values = lambda name: F.coalesce(F.transform(F.try_element_at(headers, F.lit(name)), lambda v: fold_space(strip_nul(v))), F.array().cast("array<string>"))
    pairs = [F.concat(F.lit(f'["{name}",'), canonical(values(name), "array<string>"), F.lit("]")) for name in STABLE_HEADERS]
    return content_hash(F.concat(F.lit("["), F.concat_ws(",", *pairs, canonical(size.cast("long"), "long")), F.lit("]")))


def content_hash(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def identity_key(trusted_id: Column, mid: Column, stable_hash: Column, trust: Column) -> Column:
    """The trusted id if it is trusted and well formed, else the Message-ID, else the hash of stable headers."""
    trusted_id = F.regexp_replace(F.replace(trusted_id, F.lit("\x00"), F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    trust = trust & trusted_id.rlike(TRUSTED_PATTERN)
    return F.coalesce(
        F.when(trust & (F.length(trusted_id) > 0), F.concat(F.lit("pm:"), trusted_id)),
        F.concat(F.lit("mid:"), mid),
        F.concat(F.lit("hdr:v1:"), stable_hash),
    )
