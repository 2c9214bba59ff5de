"""Classes of fetch outcomes, and the authority of a url."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The class of a connection error by what its message contains; the first that matches counts.
CONNECTION_ERRORS = [
    ("nameresolutionerror", "dns_error"),
    ("name or service not known", "dns_error"),
    ("nodename nor servname", "dns_error"),
    ("no address associated with hostname", "dns_error"),
    ("connection refused", "connection_refused"),
    ("connection reset", "connection_reset"),
    ("remotedisconnected", "remote_disconnected"),
    ("network is unreachable", "network_unreachable"),
    ("newconnectionerror", "new_connection_error"),
]


def connection_error_class(message: Column) -> Column:
    """Class of a connection error's message."""
    text, out = F.lower(message), None
    for part, name in CONNECTION_ERRORS:
        out = (F.when if out is None else out.when)(text.contains(part), name)
    return out.otherwise("connection_error_other")


def fetch_status(code: Column, error: Column, message: Column) -> Column:
    """Status of a fetch: the code, or the class of the error that took its place."""
    return (
        F.when(code.isNotNull(), code.cast("string"))
        .when(error == "ConnectTimeout", "connect_timeout")
        .when(error == "ReadTimeout", "read_timeout")
        .when(error == "SSLError", "ssl_error")
        .when(error == "ConnectionError", connection_error_class(message))
        .otherwise(F.concat(F.lit("other_error:"), F.coalesce(error, F.lit("unknown"))))
    )


def authority(url: Column) -> Column:
    """What stands between '//' and the path, with user info and port; empty without '//'."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
