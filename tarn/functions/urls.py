"""URL functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^([^:/?#]+)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def normalise_url(url: Column) -> Column:
    """Canonical http(s) URL without fragment, default port or trailing slashes; null if it is none."""
    trimmed = F.regexp_replace(url, r"^\s+|\s+$", "")
    part = lambda n: F.regexp_extract(trimmed, _PARTS, n)
    scheme = F.lower(part(1))
    host = F.lower(part(2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    path = F.regexp_replace(F.btrim(part(3)), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    query = F.when(part(4) == "?", "").otherwise(part(4))
    return F.when(scheme.isin("http", "https"), F.concat(scheme, F.lit("://"), host, path, query))


def host_of(url: Column) -> Column:
    """Network location of a normalised URL, port included."""
    return F.regexp_extract(url, _PARTS, 2)


def allowed_host(url: Column, hosts: list[str] | None) -> Column:
    return F.lit(True) if hosts is None else host_of(url).isin([h.lower() for h in hosts])
