"""Plan properties that matter at scale."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from skywarden.catalog.detectors import SPARK as DETECTORS
from skywarden.catalog.base import FLEET, GATEWAYS
from skywarden.catalog.verdicts import SETTINGS
from skywarden.derived import packets
from skywarden.functions import scope
from skywarden.operators import tracks as T
from skywarden.plans import drone_application, drone_transport, layers, network

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", DETECTORS)
def test_no_cross_join_and_no_unpartitioned_window(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Exchange SinglePartition" not in text


@pytest.mark.parametrize("name", ["deauth_attack", "syn_flood", "drone_udp_flood", "icmp_flood", "http_attack"])
def test_rate_detectors_shuffle_rows_once_by_key_and_slice(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert len(exchanges) == 1 and "_slice" in exchanges[0]


def test_scope_filters_reach_the_scan(spark):
    text = plan(scope.host_filter(packets(spark, SF), "10.0.0.1").select("packet_id"))
    assert re.search(r"PushedFilters: \[.*EqualTo\(src_ip,10\.0\.0\.1\)", text)
    assert "payload" not in re.search(r"ReadSchema: (\S+)", text).group(1)


def test_payload_is_not_shuffled(spark):
    text = plan(entry.queries()["http_attack"](spark, SF))
    for line in text.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "payload" not in line


@pytest.mark.parametrize("name", ["arp_spoofing", "ip_spoofing", "evil_twin", "port_scan", "many_macs_per_ip", "drone_port_scan"])
def test_no_row_is_joined_by_the_bare_key(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "Join" not in text
    assert any("_slice" in line for line in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text))


def test_all_layers_scan_the_packets_once(spark, monkeypatch):
    """Whatever is written on the way, only the table of events is made from packets, with one scan."""
    source = packets(spark, SF).inputFiles()[0].rsplit("/", 1)[0].rsplit("/", 1)[1]
    scans = []
    real = T.written

    def noted(df, name):
        scans.append((name, plan(df).count(source)))
        return real(df, name)
    monkeypatch.setattr(T, "written", noted)
    monkeypatch.setattr(layers, "written", noted)
    alerts = layers.alerts_of_layers(packets(spark, SF), FLEET, GATEWAYS, SETTINGS)
    assert [x for x in scans if x[1]] == [("events", 1)]
    assert source not in plan(alerts)
    log = network.network_log(packets(spark, SF))
    assert scans[-2] == ("events", 1) and plan(log).count(source) == 1


def test_events_leave_payloads_behind(spark):
    rows = drone_transport.prepared(packets(spark, SF), FLEET).select("*", *drone_application.message_columns())
    tagged = T.events(rows, layers.all_tracks(FLEET, GATEWAYS, SETTINGS), [*drone_transport.CARRY, "mavlink"])
    assert "payload" not in str(tagged.schema)
    assert "Exchange" not in plan(tagged)


def test_openings_add_up_over_eras(spark, monkeypatch):
    monkeypatch.setattr(T, "ERA", 3)
    rows = [(0, ["a"], s, s % 5, -s) for s in range(-7, 30, 2)] + [(1, ["a"], 4, 7, 1)]
    df = spark.createDataFrame(rows, "track int, key array<string>, slice long, amount long, lo long")
    found = {(r.track, r.slice): (r.amount, r.lo) for r in T.opened(df, ["amount"], "lo").collect()}
    want = {(t, s): (sum(x[3] for x in rows if x[0] == t and x[2] < s), min(x[4] for x in rows if x[0] == t and x[2] <= s)) for t, _, s, _, _ in rows}
    assert found == want
