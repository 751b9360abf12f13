from __future__ import annotations


def ids(df) -> list[int]:
    return sorted(r.packet_id for r in df.select("packet_id").collect())
