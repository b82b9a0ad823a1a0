"""Columns over URLs. Anything that is no absolute http(s) URL is left as it is, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ABSOLUTE = r"^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, "(?i)" + _ABSOLUTE, group)


def is_absolute(url: Column) -> Column:
    return url.rlike("(?i)" + _ABSOLUTE)


def host_of(url: Column) -> Column:
    """Lower-case host with a port that is not the scheme's own; null for anything that is no URL."""
    host = F.lower(F.regexp_replace(_part(url, 2), "^[^@]*@", ""))
    own = F.when(F.lower(_part(url, 1)) == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    return F.when(is_absolute(url), own)


def domain_of(url: Column) -> Column:
    """Host name without port and www., lower case; empty for anything that is no URL."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(host_of(url), r":\d+$", ""), r"^www\.", ""), F.lit(""))


def owns(domain: Column, host: Column) -> Column:
    """Whether a domain is a host or lies below it."""
    return (domain == host) | domain.endswith(F.concat(F.lit("."), host))


def endings(domain: Column) -> Column:
    """A domain and all it lies below, so that domains and their owners meet by an equal key."""
    labels = F.split(domain, r"\.")
    return F.when(domain != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))


def path_of(url: Column) -> Column:
    """Path and query of a URL, at least a slash; other texts unchanged."""
    path = _part(url, 3)
    return F.when(is_absolute(url), F.concat(F.when(path == "", "/").otherwise(path), _part(url, 4))).otherwise(url)


def path_only(path: Column) -> Column:
    """A path without its query."""
    return F.substring_index(path, "?", 1)


def url_key(url: Column) -> Column:
    """Join key of a URL: no fragment, no slash at the end, lower-case host, query kept."""
    path = _part(url, 3)
    trimmed = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    return F.when(is_absolute(url), F.concat(F.lower(_part(url, 1)), F.lit("://"), host_of(url), trimmed, _part(url, 4))).otherwise(url)


def norm_url(url: Column) -> Column:
    """A URL without fragment, its host lower case and without default port; null if not http(s)."""
    path = _part(url, 3)
    return F.when(is_absolute(url), F.concat(F.lower(_part(url, 1)), F.lit("://"), host_of(url), F.when(path == "", "/").otherwise(path), _part(url, 4)))


def first_dir(path: Column) -> Column:
    """First segment of a path as /segment/, a file counting as a directory; else a slash."""
    first = F.regexp_extract(path_only(path), "^/*([^/]+)", 1)
    return F.when(first == "", "/").otherwise(F.concat(F.lit("/"), first, F.lit("/")))


def first_folder(path: Column) -> Column:
    """First segment as /segment/ only if something follows it; else a slash."""
    first = F.regexp_extract(path_only(path), "^/*([^/]+)/+[^/]", 1)
    return F.when(first == "", "/").otherwise(F.concat(F.lit("/"), first, F.lit("/")))


def prefixes(path: Column) -> Column:
    """All folders above a path, from the root down: /, /a/, /a/b/."""
    parts = F.filter(F.split(path_only(path), "/"), lambda x: x != "")
    folders = F.when(path_only(path).endswith("/"), parts).otherwise(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    return F.transform(F.sequence(F.lit(0), F.size(folders)), lambda n: F.when(n == 0, F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(folders, 1, n), "/"), F.lit("/"))))


def query_keys(path: Column) -> Column:
    """Names of the query parameters of a path, in order."""
    query = F.when(path.contains("?"), F.regexp_extract(path, r"\?([^#]*)", 1)).otherwise("")
    return F.filter(F.transform(F.split(query, "&"), lambda kv: F.substring_index(kv, "=", 1)), lambda k: k != "")


def parts(url: Column) -> Column:
    """Scheme, host, path, query and fragment as one struct."""
    return F.struct(F.lower(_part(url, 1)).alias("scheme"), host_of(url).alias("host"), _part(url, 3).alias("path"), F.regexp_replace(_part(url, 4), r"^\?", "").alias("query"), F.regexp_replace(_part(url, 5), "^#", "").alias("fragment"))
