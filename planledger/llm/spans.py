"""Spans of texts: their Arrow form and the texts and digests made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,stop:int,base:boolean>"


def listed(spans: Column | str) -> Column:
    """``kind:start:stop`` of each span, comma-joined, in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def base(spans: Column | str) -> Column:
    return F.filter(spans, lambda s: s["base"])


def count(spans: Column | str, kind: str) -> Column:
    """How many base spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def digest(spans: Column | str) -> Column:
    """Lower-case SHA-256 of the base spans as listed."""
    return F.sha2(listed(base(spans)).cast("binary"), 256)
