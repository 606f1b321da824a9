"""Index names and token helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_encode(c: Column) -> Column:
    """RFC 3986 encoding of all but letters, digits and ``-._~``."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def percent_decode(c: Column) -> Column:
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def index_name(domain: Column, commit: Column) -> Column:
    """``domain@commit`` with the domain encoded."""
    return F.concat(percent_encode(domain), F.lit("@"), commit)


def parse_index_name(name: Column) -> Column:
    """A struct (domain, commit), cut at the first @."""
    parts = F.split(name, "@", 2)
    return F.struct(percent_decode(F.element_at(parts, 1)).alias("domain"), F.try_element_at(parts, F.lit(2)).alias("commit"))


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def truncate_tokens(tokens: Column, most: int = 8191) -> Column:
    """The first ``most`` tokens; null stays null."""
    return F.slice(tokens, 1, most)
