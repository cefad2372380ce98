"""Which node of a cluster owns a contract: a ring of hashed node names, each with several places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The 32-bit FNV-1a hash: fixed values.
OFFSET, PRIME = 2166136261, 16777619


def fnv(data: bytes) -> int:
    h = OFFSET
    for b in data:
        h = (h ^ b) * PRIME & 0xFFFFFFFF
    return h


def fnv_of(text: Column) -> Column:
    """The same hash of a string column's UTF-8 bytes."""
    octets = F.hex(F.encode(text, "utf-8"))
    at = F.filter(F.sequence(F.lit(-1), F.length(octets) - 1, F.lit(2)), lambda i: i > 0)
    step = lambda h, i: (h.bitwiseXOR(F.conv(F.substring(octets, i, F.lit(2)), 16, 10).cast("long")) * PRIME).bitwiseAND(0xFFFFFFFF)
    return F.aggregate(at, F.lit(OFFSET).cast("long"), step)


def places(nodes: list[str], replicas: int = 20) -> list[tuple[int, str]]:
    """The ring: places of each node, in order."""
    return sorted((fnv(f"{i}{node}".encode()), node) for node in nodes for i in range(replicas))


def node_of(contract: Column, nodes: list[str], replicas: int = 20) -> Column:
    """The node at the first place at or after the contract's hash, or at the first of all; null without nodes.

    Work for each row grows with the number of places, which is that of machines and not of rows; no shuffle.
    """
    ring = places(nodes, replicas)
    if not ring:
        return F.lit(None).cast("string")
    text = contract.cast("string")
    found = F.transform(F.array(fnv_of(text)), lambda h: F.get(F.filter(F.array(*(F.struct(F.lit(x).cast("long").alias("h"), F.lit(n).alias("n")) for x, n in ring)), lambda p: (p["h"] > h) | ((p["h"] == h) & (p["n"] >= text))), F.lit(0))["n"])
    return F.when(text.isNotNull(), F.coalesce(F.get(found, F.lit(0)), F.lit(ring[0][1])))


def routed(rows: DataFrame, nodes: list[str], own: str | None = None, replicas: int = 20) -> DataFrame:
    """rows with ``node`` and whether that is another one than ``own``; without ``own`` no contract is remote."""
    rows = rows.withColumn("node", node_of(F.col("contract"), nodes, replicas))
    return rows.withColumn("remote", F.lit(False) if own is None else F.col("node") != own)
