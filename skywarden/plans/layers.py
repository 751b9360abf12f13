"""Alerts of all layers from one scan of the packets.

The detectors of the six layers are tracks of one table of events; connections, payloads and position updates are fed from the same
table to the operators that cannot be a running sum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from skywarden.functions import scope
from skywarden.operators.tracks import FEED, Track, events, fired, state_of
from skywarden.operators.verdict import resolve_layers
from skywarden.plans import drone_application, drone_internet, drone_network, drone_transport, internet, network
from skywarden.plans.marks import flags_by_packet
from skywarden.session import written
from skywarden.streaming.following import stream_hits

Settings = Mapping[str, Mapping[str, object]]
FOUND = ["layer", "packet_id", "detector", "position", "rank", "severity", "details"]


def all_tracks(fleet: Sequence[str], gateways: Sequence[str], settings: Settings) -> list[Track]:
    """Tracks of every layer, those that only feed other operators last."""
    mine = {layer: dict(settings.get(layer, {})) for layer in ("network", "internet", "drone_network", "drone_internet", "drone_transport", "drone_application")}
    mine["drone_network"].pop("gap_s", None)
    for setting in ("gap_s", "anomalies"):
        mine["drone_transport"].pop(setting, None)
    layers = {
        "network": network.tracks(**mine["network"]), "internet": internet.tracks(**mine["internet"]),
        "drone_network": drone_network.tracks(fleet[:1], **mine["drone_network"]),
        "drone_internet": drone_internet.tracks(fleet, gateways, **mine["drone_internet"]),
        "drone_transport": drone_transport.tracks(fleet, **mine["drone_transport"]),
        "drone_application": drone_application.tracks(scope.in_fleet_application(fleet), **mine["drone_application"])}
    named = [replace(track, layer=layer) for layer, tracks in layers.items() for track in tracks]
    return sorted(named, key=lambda track: track.kind == FEED)


def alerts_of_layers(packets: DataFrame, fleet: Sequence[str], gateways: Sequence[str] = ("",), settings: Settings | None = None) -> DataFrame:
    """layer, packet_id, attack_type, severity, details: one row per attacked packet and layer. ``fleet[0]`` is the drone itself."""
    settings = settings or {}
    tracks = all_tracks(fleet, gateways, settings)
    carry = sorted({*drone_network.CARRY, *drone_internet.CARRY, *drone_transport.CARRY, *drone_application.CARRY})
    rows = drone_transport.prepared(packets, fleet).select("*", *drone_application.message_columns())
    tagged = written(events(rows, tracks, carry), "events")
    hits = written(fired(state_of(tagged, tracks), tracks).select(*FOUND), "hits")

    def kept(layer: str, *names: str) -> dict[str, object]:
        return {name: settings[layer][name] for name in names if name in settings.get(layer, {})}
    fed = {"drone_network": drone_network.fed_hits(tagged, tracks, **kept("drone_network", "gap_s")),
           "drone_transport": drone_transport.fed_hits(tagged, tracks, **kept("drone_transport", "anomalies", "gap_s"))}
    found = hits
    for layer, more in fed.items():
        found = found.unionByName(more.withColumns({"layer": F.lit(layer), "rank": F.lit(0)}))
    return verdicts(found)


def hits_of_stream(packets: DataFrame, fleet: Sequence[str], gateways: Sequence[str] = ("",), settings: Settings | None = None,
                   delay: str | None = None) -> DataFrame:
    """Hits of all layers over a stream of packets, but for the detectors that need an operator of another kind."""
    tracks = [track for track in all_tracks(fleet, gateways, settings or {}) if track.kind != FEED]
    carry = sorted({*drone_network.CARRY, *drone_internet.CARRY, *drone_application.CARRY})
    rows = packets.select("*", *drone_application.message_columns())
    return stream_hits(rows, tracks, carry, delay).select(*FOUND)


def verdicts(hits: DataFrame) -> DataFrame:
    """layer, packet_id, attack_type, severity, details of hits of any layers, as ``alerts_of_layers``."""
    best = resolve_layers(hits.where(F.col("layer") != "internet"), drone_application.OUTRANKED)
    # the internet layer names all its detectors
    named = flags_by_packet(hits.where(F.col("layer") == "internet"), internet.DETECTORS).select(
        F.lit("internet").alias("layer"), "packet_id", internet.alert_text().alias("attack_type"), F.lit(1.0).alias("severity"),
        F.lit("").alias("details"))
    return best.unionByName(named)
