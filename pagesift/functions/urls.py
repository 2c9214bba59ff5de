"""Hosts and sites that urls really point to."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCHEME = re.compile(r"^[a-z][a-z0-9+.\-]*:", re.I)
_PORT = re.compile(r":\d*$")


def host_of(url: str | None) -> str | None:
    """The host a browser would connect to, normalised; None where there is none.

    User info before '@' is not the host, back slashes count as slashes, case,
    ports, a trailing dot, percent escapes and IDN spelling don't matter.
    """
    if url is None:
        return None
    text = re.sub("[\\t\\r\\n\\u00ad\\u200b\\ufeff]", "", url).strip().replace("\\", "/")
    if not text:
        return None
    found = _SCHEME.match(text)
    # "host:8080/x" has no scheme, though it looks like one
    if found and (text[found.end() : found.end() + 1] == "/" or not re.match(r"\d*(?:[/?#]|$)", text[found.end() :])):
        if "@" not in found.group() and "." not in found.group():
            text = text[found.end() :]
    text = text.lstrip("/")
    authority = re.split(r"[/?#]", text, maxsplit=1)[0]
    host = authority.rpartition("@")[2]
    if host.startswith("["):
        inner = host[1:].partition("]")[0].partition("%")[0]
        try:
            address = ipaddress.ip_address(inner)
        except ValueError:
            return None
        mapped = getattr(address, "ipv4_mapped", None)
        return str(mapped or address)
    host = unicodedata.normalize("NFKC", unquote(_PORT.sub("", host))).lower()
    host = host.replace("。", ".").strip().rstrip(".")
    if not host:
        return None
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            pass
    return _ipv4(host) or host


def _ipv4(host: str) -> str | None:
    """The dotted form of an IPv4 address in any numeral spelling."""
    parts = host.split(".")
    if len(parts) > 4 or not re.fullmatch(r"\d+|0x[0-9a-f]*", parts[-1]):
        return None
    values = []
    for part in parts:
        try:
            if part.startswith("0x"):
                values.append(int(part[2:] or "0", 16))
            else:
                values.append(int(part, 8 if len(part) > 1 and part[0] == "0" else 10))
        except ValueError:
            return None
    if any(v > 255 for v in values[:-1]) or values[-1] >= 256 ** (5 - len(values)):
        return None
    number = values[-1] + sum(v << (8 * (3 - i)) for i, v in enumerate(values[:-1]))
    return str(ipaddress.ip_address(number))


def site_of(url: str | None) -> str | None:
    """Last two labels of the host; a literal address is its own site."""
    host = host_of(url)
    if host is None:
        return None
    try:
        return str(ipaddress.ip_address(host))
    except ValueError:
        return ".".join([x for x in host.split(".") if x][-2:]) or None


@F.pandas_udf(T.StringType())
def site(urls: pd.Series) -> pd.Series:
    """``site_of`` over Arrow batches; each distinct url of a batch is parsed once."""
    known = {u: site_of(u) for u in urls.dropna().unique()}
    return urls.map(known).astype(object).where(urls.notna(), None)


@F.pandas_udf(T.StringType())
def host(urls: pd.Series) -> pd.Series:
    """``host_of`` over Arrow batches."""
    known = {u: host_of(u) for u in urls.dropna().unique()}
    return urls.map(known).astype(object).where(urls.notna(), None)
