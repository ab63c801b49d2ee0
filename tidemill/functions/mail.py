"""Parts of mail messages: header blocks, display names, dates, the text part and the attachments of a tree of parts."""

from __future__ import annotations

import datetime
import re
from email.header import decode_header, make_header
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, TimestampNTZType

from .text import strip_nul

# Values of a header, code points of a value, attachments of a message.
MAX_VALUES, MAX_VALUE, MAX_ATTACHMENTS = 20, 2000, 100


def _decode(value: str | None) -> str | None:
    """Encoded words decoded; what cannot be decoded stays as it is."""
    if value is None or "=?" not in value:
        return value
    try:
        return str(make_header(decode_header(value)))
    except (ValueError, LookupError, UnicodeError):
        return value


@pandas_udf(StringType())
def _decoded(s: pd.Series) -> pd.Series:
    return s.map(_decode)


@pandas_udf(ArrayType(StringType()))
def _decoded_all(s: pd.Series) -> pd.Series:
    return s.map(lambda values: None if values is None else [_decode(v) for v in values])


def decoded_words(value: Column) -> Column:
    """A header value with its encoded words decoded; values without any stay in the JVM."""
    return F.when(F.contains(value, F.lit("=?")), _decoded(value)).otherwise(value)


def header_fields(block: Column, decode: bool = False) -> Column:
    """array<struct<name, value>> of a raw header block: folded lines joined, names in lower case, bad names dropped.

    With ``decode`` encoded words are decoded, which comes before values lose NUL and are cut to MAX_VALUE code points; keys and hashes of
    messages read the values as they were sent. Blocks without encoded words stay in the JVM.
    """
    unfolded = F.regexp_replace(F.regexp_replace(block, r"\r\n?", "\n"), r"\n[ \t]+", " ")
    lines = F.filter(F.split(unfolded, "\n"), lambda x: x.rlike(r"^[!-9;-~]+[ \t]*:"))
    names = F.transform(lines, lambda x: F.lower(F.regexp_extract(x, r"^([!-9;-~]+)", 1)))
    values = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^[^:]*:", ""), r"[\t ]+", " ")))
    if decode:
        values = F.when(F.contains(block, F.lit("=?")), _decoded_all(values)).otherwise(values)
    return F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), F.substring(strip_nul(v), 1, MAX_VALUE).alias("value")))


def header_values(fields: Column, name: str) -> Column:
    """The values of one header in order, MAX_VALUES at most."""
    return F.slice(F.transform(F.filter(fields, lambda f: f["name"] == name), lambda f: f["value"]), 1, MAX_VALUES)


def header_map(fields: Column) -> Column:
    """map<name, array<value>> of the fields."""
    names = F.array_distinct(F.transform(fields, lambda f: f["name"]))
    values = lambda n: F.slice(F.transform(F.filter(fields, lambda f: f["name"] == n), lambda f: f["value"]), 1, MAX_VALUES)
    return F.map_from_arrays(names, F.transform(names, values))


def display_name(header: Column) -> Column:
    """The name of the first address in a From header: the words before its brackets, quoted ones without their quotes, or the comment after a bare address; null without one."""
    before = F.regexp_extract(header, r'^\s*((?:"(?:[^"\\]|\\.)*"|[^<",])*)<[^>]*>', 1)
    bare = F.regexp_replace(F.regexp_replace(before, r'"((?:[^"\\]|\\.)*)"', "$1"), r"\\(.)", "$1")
    comment = F.regexp_extract(header, r'^\s*[^\s<>",()]+@[^\s<>",()]+\s*\(([^)]*)\)', 1)
    return F.coalesce(F.nullif(F.trim(bare), F.lit("")), F.nullif(F.trim(comment), F.lit("")))


_MAIL_DATE = re.compile(r"^\s*(?:[A-Za-z]{3},)?\s*\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s+\d{2}:\d{2}")


@pandas_udf(TimestampNTZType())
def mail_date(s: pd.Series) -> pd.Series:
    """A Date header as a UTC timestamp; null for what is none."""

    def parse(value):
        if value is None or not _MAIL_DATE.match(value):
            return None
        try:
            found = parsedate_to_datetime(value)
        except (ValueError, TypeError, IndexError):
            return None
        return found.astimezone(datetime.UTC).replace(tzinfo=None) if found.tzinfo else found

    return pd.to_datetime(s.map(parse))


def parts_with_text(parts: Column) -> Column:
    """Of the parts in depth-first order those that may be the text: no attachments, nothing inside an embedded message."""
    return F.filter(parts, lambda p: ~is_attachment(p) & ~p["embedded"])


def is_attachment(part: Column) -> Column:
    return F.coalesce(F.lower(part["disposition"]) == "attachment", F.lit(False))


def text_part(parts: Column) -> Column:
    """The part to read: the first text/plain, else the first text/html, else null."""
    usable = parts_with_text(parts)
    of = lambda kind: F.get(F.filter(usable, lambda p: F.lower(p["mime_type"]) == kind), F.lit(0))
    return F.coalesce(of("text/plain"), of("text/html"))


def attachments(parts: Column) -> Column:
    """array<struct<name, mime_type, size_bytes>>, MAX_ATTACHMENTS at most; a part without a type is a stream of octets."""
    mine = F.filter(parts, lambda p: is_attachment(p) & ~p["embedded"])
    describe = lambda p: F.struct(p["name"].alias("name"), F.coalesce(F.lower(p["mime_type"]), F.lit("application/octet-stream")).alias("mime_type"), p["size_bytes"].alias("size_bytes"))
    return F.slice(F.transform(mine, describe), 1, MAX_ATTACHMENTS)
