"""Text functions as Column expressions; what Spark lacks is an Arrow UDF, kept off the path of plain ASCII."""

from __future__ import annotations

import re
import unicodedata
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Fixed value: the white space that normalisation folds (Java's \s knows only ASCII).
SPACE = r"[\x09-\x0d\x20   -     　﻿]"


@pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def fold_space(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def normalise(text: Column, ascii_only: bool = False) -> Column:
    """NFKC, lower case, white space folded. ``ascii_only`` promises ASCII text, for which NFKC changes nothing, and stays in the JVM."""
    return fold_space(F.lower(text if ascii_only else _nfkc(text)))


def truncated(text: Column, n: int) -> Column:
    """struct<text, truncated>: at most ``n`` code points."""
    return F.struct(F.substring(text, 1, n).alias("text"), (F.length(text) > n).alias("truncated"))


def utf16_cut(text: Column, n: int) -> Column:
    """At most ``n`` UTF-16 units, no pair split: code points beyond the basic plane count two."""

    @pandas_udf(StringType())
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else t.encode("utf-16-le")[: 2 * n].decode("utf-16-le", "ignore"))

    return F.when(F.length(text) * 2 <= n, text).otherwise(cut(text))


def utf16_units(text: Column) -> Column:
    """How many UTF-16 units a text has: each code point beyond the basic plane, four bytes in UTF-8, counts two."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def strip_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\x00"), F.lit(""))


def clean_for_prompt(text: Column) -> Column:
    """Line ends as LF, no control characters but LF and tab, at most one empty line in a row."""
    lf = F.regexp_replace(text, r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lf, r"[\p{Cc}&&[^\n\t]]", ""), r"\n{3,}", "\n\n")


def one_line(text: Column, n: int = 300) -> Column:
    return F.substring(F.trim(F.regexp_replace(clean_for_prompt(text), r"[\n\t ]+", " ")), 1, n)


def redact(text: Column, secrets: list[str]) -> Column:
    """Literal secrets, longest first, and passwords in URLs, replaced by a mark."""
    for secret in sorted({s for s in secrets if s}, key=lambda s: (-len(s), s)):
        text = F.replace(text, F.lit(secret), F.lit("[redacted]"))
    return F.regexp_replace(text, r"([a-z][a-z0-9+.-]*://[^/\s:@]*):[^/\s@]+@", "$1:[redacted]@")


def address_parts(address: Column) -> Column:
    """struct<address, domain>: split at the last @, the domain in lower case; null without both."""
    at = F.length(address) - F.length(F.substring_index(address, "@", -1))
    domain = F.lower(F.substring_index(address, "@", -1))
    whole = F.when((at > 1) & (F.length(domain) > 0), F.struct(F.concat(F.substring(address, F.lit(1), at), domain).alias("address"), domain.alias("domain")))
    return whole


def is_slug(text: Column, reserved: tuple[str, ...] = ()) -> Column:
    return text.rlike(r"^[a-z0-9](?:[a-z0-9-]{0,62}[a-z0-9])?$") & ~text.isin(*reserved) if reserved else text.rlike(r"^[a-z0-9](?:[a-z0-9-]{0,62}[a-z0-9])?$")


def day(text: Column) -> Column:
    """A strict YYYY-MM-DD date; null for anything else, impossible days included."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))


# Elements that are no text, that stand on lines of their own, that have no end tag; how deep elements may be nested for their text to be read.
_SILENT, _LINES = {"script", "style"}, {"p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
MAX_DEPTH = 200


class _Text(HTMLParser):
    """Text of a page by its tags: nothing of scripts and styles, of pictures or of targets of links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.silent, self.depth = [], 0, 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in _SILENT
        self.depth += tag not in _VOID
        if tag in _LINES:
            self.parts.append("\n")

    def handle_startendtag(self, tag, attrs):
        if tag in _LINES:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.silent = max(0, self.silent - (tag in _SILENT))
        self.depth = max(0, self.depth - (tag not in _VOID))
        if tag in _LINES:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.silent and self.depth <= MAX_DEPTH:
            self.parts.append(data)


def _text_of(source: str | None) -> str | None:
    if source is None:
        return None
    parser = _Text()
    parser.feed(source)
    parser.close()
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(parser.parts).split("\n")) if x)


#: An ampersand, with the reference that it begins if that ends in a semicolon.
_REFERENCE = re.compile(r"&(?:(#(?:[0-9]+|[xX][0-9A-Fa-f]+);)|([A-Za-z][A-Za-z0-9]*;))?")


def _text_of_closed(source: str | None) -> str | None:
    if source is None or "&" not in source:
        return _text_of(source)
    mark = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in source)  # stands for an ampersand that begins no closed reference
    return _text_of(_REFERENCE.sub(lambda m: m[0] if m[1] or m[2] in html5 else mark + m[0][1:], source)).replace(mark, "&")


@pandas_udf(StringType())
def html_text(s: pd.Series) -> pd.Series:
    """The text of a message body in HTML, without scripts and styles, links as their words; what is nested deeper than MAX_DEPTH is left out."""
    return s.map(_text_of)


@pandas_udf(StringType())
def html_text_closed(s: pd.Series) -> pd.Series:
    """``html_text`` that reads a character reference only if it ends in its semicolon: "&amp" where a text was cut stays as it is, where HTML's rule for old names makes it "&"."""
    return s.map(_text_of_closed)


def html_text_plain(html: Column) -> Column:
    """A form of ``html_text`` by patterns alone, in the JVM: scripts, styles and tags removed, white space folded."""
    bare = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"[\x09-\x0d\x20]+", " "))


# Forms of what owners write (white space is JavaScript's), and their greatest lengths in code points.
_NO_SPACE = SPACE[1:-1]
FORMS = {
    "category": (r"^[A-Za-z0-9&-]+(?: [A-Za-z0-9&-]+)*\z", 40),
    "address": (rf"^[^{_NO_SPACE}@]+@[^{_NO_SPACE}@]+\z", 254),
    "domain": (rf"^[^{_NO_SPACE}@.]+(\.[^{_NO_SPACE}@.]+)*\z", 253),
    "hash": (r"^[0-9a-f]{64}\z", 64),
}
#: Fixed value: characters that no entry holds.
CONTROL_PATTERN = r"[\p{Cc}\u2028\u2029]"


def form_check(kind: str, value: Column) -> Column:
    """ok, empty, too_long, control or malformed: whether a value has the fixed form of a category, an address, a domain or a hash; null is empty. Patterns are anchored at both ends."""
    pattern, most = FORMS[kind]
    return (
        F.when(value.isNull() | (F.length(value) == 0), "empty")
        .when(F.length(value) > most, "too_long")
        .when(value.rlike(CONTROL_PATTERN), "control")
        .when(~value.rlike(pattern), "malformed")
        .otherwise("ok")
    )
