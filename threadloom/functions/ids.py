"""Deterministic ids of stored chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace for domain names in the UUID standard.
NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE_DNS) -> Column:
    """The name-based UUID (version 5) of a text, computed by built-in functions only."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    # the first two bits of byte 8 are 10: its high half becomes one of 8, 9, a, b
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def point_id(ticket: Column, article: Column, chunk: Column) -> Column:
    return uuid5(F.concat_ws("_", ticket.cast("string"), article.cast("string"), chunk.cast("string")))
