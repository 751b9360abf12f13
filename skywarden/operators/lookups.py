"""Lookups in rule, gateway and fleet tables. Spark picks the join by the table's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skywarden.functions import scalars as X


def name_of(code: str | Column, names: dict[int, str], default: Column | str = "Unknown") -> Column:
    """Name of a code in a small fixed table, as an expression (no join, no shuffle)."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    default = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.element_at(table, X.col(code)), default)


def message_name(code: str | Column, names: dict[int, str]) -> Column:
    return name_of(code, names, F.concat(F.lit("MSG_"), X.col(code).cast("string")))


def rule_table(spark: SparkSession, names: dict, columns: tuple[str, str]) -> DataFrame:
    return spark.createDataFrame(list(names.items()), list(columns))


def with_service(packets: DataFrame, services: DataFrame, port: str = "dport") -> DataFrame:
    """Left join of a (port, service) table; unknown ports are ``Unknown``."""
    known = services.select(F.col("port").alias(port), "service")
    return packets.join(known, port, "left").withColumn("service", F.coalesce("service", F.lit("Unknown")))


def outside_gateways(packets: DataFrame, gateways: DataFrame, subnet: str = "192.168.4.") -> DataFrame:
    """Packets whose source is no known gateway and not in the expected subnet."""
    known = gateways.select(F.col("ip").alias("src_ip")).distinct()
    return packets.where(~F.startswith(F.col("src_ip"), F.lit(subnet))).join(known, "src_ip", "left_anti")


def with_fleet(alerts: DataFrame, fleet: DataFrame) -> DataFrame:
    """Add ``src_role``, ``dst_role`` and ``involves_fleet`` from a (ip, role) table."""
    fleet = fleet.dropDuplicates(["ip"])
    for side in ("src", "dst"):
        alerts = alerts.join(fleet.select(F.col("ip").alias(f"{side}_ip"), F.col("role").alias(f"{side}_role")),
                             f"{side}_ip", "left")
    return alerts.withColumn("involves_fleet", F.col("src_role").isNotNull() | F.col("dst_role").isNotNull())
