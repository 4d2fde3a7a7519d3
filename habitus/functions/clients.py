"""Who made a request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def client_key(forwarded_for: Column, host: Column) -> Column:
    """First hop of the forwarding header, else the socket address, else unknown.

    White space of any kind around the hop is dropped.
    """
    hop = F.split_part(forwarded_for, F.lit(","), F.lit(1))
    first_hop = F.regexp_replace(hop, r"(?U)^\s+|\s+$", "")
    return F.when(forwarded_for != "", first_hop).otherwise(
        F.coalesce(host, F.lit("unknown"))
    )


def accessor(analyst: Column, client: Column) -> Column:
    """The named analyst of an access, else the client it came from."""
    return F.coalesce(analyst, client)
