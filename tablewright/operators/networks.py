"""Joins of addresses with networks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import net


def address_network_join(addresses: DataFrame, networks: DataFrame, address: str, network: str) -> DataFrame:
    """Pairs of an address and a network that holds it.

    Addresses are cut to each prefix length in use (at most 161) and joined by
    equality on the cut prefix, so no pair is tried that does not match.
    """
    nets = networks.withColumn("__bits", F.col(f"{network}.bits")).withColumn("__family", F.col(f"{network}.family"))
    nets = nets.withColumn("__prefix", net.network_hex(F.col(f"{network}.addr"), F.col("__bits")))
    lengths = [r[0] for r in nets.select("__bits").distinct().collect()] or [0]
    spots = addresses.select(address).distinct().withColumn("__bits", F.explode(F.array(*[F.lit(b) for b in sorted(lengths)])))
    spots = spots.filter(F.col("__bits") <= F.col(f"{address}.bits")).withColumn("__family", F.col(f"{address}.family"))
    spots = spots.withColumn("__prefix", net.network_hex(F.col(f"{address}.addr"), F.col("__bits")))
    hits = spots.join(nets, ["__family", "__bits", "__prefix"]).drop("__family", "__bits", "__prefix")
    return addresses.join(hits, address)
