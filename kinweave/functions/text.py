"""Text normalisation as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Latin letters and what they become in plain ASCII.
_SINGLE = {
    "ÀÁÂÃÄÅĀĂĄ": "A", "àáâãäåāăą": "a", "ÇĆĈĊČ": "C", "çćĉċč": "c", "ĎĐÐ": "D", "ďđð": "d", "ÈÉÊËĒĔĖĘĚ": "E", "èéêëēĕėęě": "e",
    "ĜĞĠĢ": "G", "ĝğġģ": "g", "ĤĦ": "H", "ĥħ": "h", "ÌÍÎÏĨĪĬĮİ": "I", "ìíîïĩīĭįı": "i", "Ĵ": "J", "ĵ": "j", "Ķ": "K", "ķ": "k",
    "ĹĻĽĿŁ": "L", "ĺļľŀł": "l", "ÑŃŅŇ": "N", "ñńņň": "n", "ÒÓÔÕÖØŌŎŐ": "O", "òóôõöøōŏő": "o", "ŔŖŘ": "R", "ŕŗř": "r", "ŚŜŞŠ": "S", "śŝşš": "s",
    "ŢŤŦ": "T", "ţťŧ": "t", "ÙÚÛÜŨŪŬŮŰŲ": "U", "ùúûüũūŭůűų": "u", "Ŵ": "W", "ŵ": "w", "ÝŶŸ": "Y", "ýÿŷ": "y", "ŹŻŽ": "Z", "źżž": "z",
    "‘’‚′": "'", "“”„": '"', "–—‐": "-",
}
_DOUBLE = {"Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss", "Þ": "Th", "þ": "th", "…": "..."}
FROM = "".join(_SINGLE)
TO = "".join(v * len(k) for k, v in _SINGLE.items())


def to_ascii(c: Column) -> Column:
    """Latin letters and typographic marks in ASCII; combining marks and everything else outside ASCII go."""
    c = F.translate(c, FROM, TO)
    for old, new in _DOUBLE.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def split_camel(c: Column) -> Column:
    return F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2")


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def contains_any(c: Column, markers: tuple[str, ...]) -> Column:
    """Whether the text holds any marker; false for null."""
    return F.coalesce(c.rlike("|".join(re.escape(m) for m in markers)), F.lit(False))


def replace_tokens(c: Column, mapping: dict[str, str]) -> Column:
    """Whole tokens between single spaces replaced by the mapping."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.array_join(F.transform(F.split(c, " "), lambda t: F.coalesce(F.element_at(table, t), t)), " ")


def strip_leading_zeros(c: Column) -> Column:
    """Leading zeros of a numeric first token go; one digit stays."""
    return F.regexp_replace(c, r"^0+(?=\d+( |$))", "")


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")
