"""Path and URL column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from spanguard.rules import lits


def normalise_path(path: Column) -> Column:
    """Back-slashes become slashes."""
    return F.translate(path, "\\", "/")


def path_parts(path: Column) -> Column:
    return F.split(path, "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lowercase suffix with its dot; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def path_stem(path: Column) -> Column:
    name = base_name(path)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)


def relative_to(path: Column, base: Column) -> Column:
    """Path below `base`; the path itself when it lies elsewhere."""
    folder = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, folder), F.substring(path, F.length(folder) + 1, F.length(path))
                  ).otherwise(path)


def in_excluded_directory(path: Column, names) -> Column:
    """True when a directory part, never the file name, is in the list."""
    parts = path_parts(path)
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), lits(names))


def traversal_order_key(path: Column) -> Column:
    """String whose byte order is the walk order: a directory's files, then its sub-directories.

    Each part gets `0` (file) or `1` (directory) in front; parts are joined by U+0001, which sorts
    below every character of a file name.
    """
    parts = path_parts(path)
    last = F.size(parts) - 1
    tagged = F.transform(
        parts, lambda x, i: F.concat(F.when(i < last, F.lit("1")).otherwise(F.lit("0")), x)
    )
    return F.array_join(tagged, "\u0001")


def url_host(url: Column) -> Column:
    """Lowercase host with user info and port removed, '' when there is none."""
    authority = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    host_port = F.regexp_replace(authority, "^.*@", "")
    bracketed = F.regexp_extract(host_port, r"^\[([^\]]*)\]", 1)
    return F.lower(
        F.when(bracketed != "", bracketed).otherwise(F.regexp_replace(host_port, ":.*$", ""))
    )
