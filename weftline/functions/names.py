"""Canonical forms of sites, authors, sources and splits, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bylines that stand in place of an author.
HOUSE_BYLINES = ("editorial team", "editorial staff", "editorial", "editors", "editor", "staff", "staff writer", "admin",
                 "administrator", "newsroom", "guest writer", "guest author", "guest")

#: Unicode white space, as (?U)\s reads it in Java.
SPACE = r"(?U)\s+"


def squeezed(column: Column) -> Column:
    """White space runs made one blank, outer white space removed."""
    return F.trim(F.regexp_replace(column, SPACE, " "))


def site(hostname: Column, href: Column) -> Column:
    """The site of a record: the host without case, outer blanks, port, final dot and leading www.

    A null or blank hostname gives way to the host in href; with neither the site is null.
    """
    from_href = F.regexp_extract(href, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1)
    host = F.lower(squeezed(F.coalesce(F.nullif(squeezed(hostname), F.lit("")), from_href)))
    for pattern in (r":\d*$", r"\.+$", r":\d*$", r"^www\."):
        host = F.regexp_replace(host, pattern, "")
    return F.nullif(host, F.lit(""))


def person(author: Column) -> Column:
    """The same key for each way to write a person's name; null for house bylines and blanks.

    Letter case, blanks, a leading "by" and the order "Last, First" don't count.
    """
    name = F.regexp_replace(F.lower(squeezed(author)), r"^by[:\s]\s*", "")
    swapped = F.regexp_replace(name, r"^([^,]+?)\s*,\s*([^,]+)$", "$2 $1")
    bare = F.regexp_replace(swapped, r"^(?:the|our)\s+", "")
    return F.when((swapped != "") & ~bare.isin(*HOUSE_BYLINES), swapped)


def split_name(split: Column) -> Column:
    """train, validation or test without regard to case and blanks; anything else is null."""
    name = F.lower(squeezed(split))
    return F.when(name.isin("train", "validation", "test"), name)


def source_name(source: Column) -> Column:
    """A source's key: letter case and outer blanks don't count."""
    return F.nullif(F.lower(squeezed(source)), F.lit(""))
