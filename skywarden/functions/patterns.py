"""Payload pattern predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from skywarden import schema as S
from skywarden.functions import scalars as X


def matched(haystack: Column, needles: Sequence[str]) -> Column:
    """The needles that occur in the text, in list order."""
    return F.array_compact(F.array(*[F.when(F.contains(haystack, F.lit(n)), F.lit(n)) for n in needles]))


def any_match(haystack: Column, needles: Sequence[str]) -> Column:
    return F.coalesce(F.size(matched(haystack, needles)) > 0, F.lit(False))


def byte_regex(pattern: str, payload: str | Column = "payload") -> Column:
    """Case-blind regular expression over bytes; ``.`` stops at a line feed only."""
    return F.coalesce(F.rlike(X.payload_latin(payload), F.lit("(?id)" + pattern)), F.lit(False))


def has_xss(payload: str | Column = "payload") -> Column:
    return byte_regex(S.XSS_REGEX, payload)


def has_sqli(payload: str | Column = "payload") -> Column:
    return byte_regex(S.SQLI_REGEX, payload)


def has_credentials(payload: str | Column = "payload") -> Column:
    return byte_regex(S.CREDENTIAL_REGEX, payload)


def is_downgrade_redirect(payload: str | Column = "payload") -> Column:
    body = F.lower(X.payload_latin(payload))
    redirect = F.contains(body, F.lit("301")) | F.contains(body, F.lit("302"))
    return F.coalesce(F.contains(body, F.lit("location: http://")) & redirect, F.lit(False))


def malicious_http(payload: str | Column = "payload") -> Column:
    return matched(X.payload_latin(payload), S.HTTP_PATTERNS)


def has_http_verb(payload: str | Column = "payload") -> Column:
    body = X.payload_text(payload)
    starts = [F.startswith(body, F.lit(verb)) for verb in S.HTTP_VERBS]
    return F.coalesce(starts[0] | starts[1] | starts[2] | starts[3], F.lit(False))


def suspicious_topics(payload: str | Column = "payload") -> Column:
    return matched(X.payload_text(payload), S.MQTT_TOPICS)


def has_rtsp_method(payload: str | Column = "payload") -> Column:
    return any_match(X.payload_text(payload), S.RTSP_METHODS)


def suspicious_rtsp(payload: str | Column = "payload") -> Column:
    return matched(X.payload_text(payload), S.RTSP_PATTERNS)


def login_markers(port: str | Column = "dport", payload: str | Column = "payload") -> Column:
    """Authentication markers for SSH (port 22) or Telnet."""
    body = X.payload_latin(payload)
    return F.when(X.col(port) == 22, matched(body, S.SSH_MARKERS)).otherwise(matched(body, S.TELNET_MARKERS))


def path_class(path: str | Column = "path") -> Column:
    """``command``, ``telemetry``, ``both`` or ``other`` by request path."""
    command, telemetry = any_match(X.col(path), S.COMMAND_PATHS), any_match(X.col(path), S.TELEMETRY_PATHS)
    return (F.when(command & telemetry, "both").when(command, "command")
            .when(telemetry, "telemetry").otherwise("other"))


def first_joined(names: Column, n: int) -> Column:
    return F.array_join(F.slice(names, 1, n), ",")
