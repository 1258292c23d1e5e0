"""Path algebra as Column expressions. A canonical path has no ``//`` and no slash at its end; the root is ``''`` inside plans
and ``'.'`` in published frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(name: Column) -> Column:
    """Collapse runs of slashes and strip trailing ones; a leading slash stays."""
    return F.rtrim(F.when(name.contains("//"), F.regexp_replace(name, "/+", "/")).otherwise(name), F.lit("/"))


def is_dirty(name: Column) -> Column:
    """True for keys that canonicalization changes."""
    return name.contains("//") | name.endswith("/")


def parent(path: Column) -> Column:
    """Text before the last slash, else the root."""
    return F.when(path.contains("/"), F.left(path, F.length(path) - F.length(basename(path)) - 1)).otherwise(F.when(path.isNotNull(), ""))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def depth(path: Column) -> Column:
    """0 for the root, else slashes plus one."""
    return F.when(path.isin("", "."), 0).otherwise(F.length(path) - F.length(F.replace(path, F.lit("/"))) + 1).cast("int")


def self_and_ancestors(path: Column) -> Column:
    """The root, every directory above ``path`` and ``path`` itself, each once."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("")), above))


def ancestors(path: Column) -> Column:
    """The root and every directory above ``path``; none for the root."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.array_except(self_and_ancestors(path), F.array(path)))


def component(path: Column, k: int) -> Column:
    """Component k (from 1) of a path, ``''`` beyond its depth."""
    return F.split_part(path, F.lit("/"), F.lit(k))


def in_subtree(path: Column, top: str) -> Column:
    """True for ``top`` and what lies under it; everything lies under the root."""
    return F.lit(True) if top in ("", ".") else (path == top) | path.startswith(top + "/")


def rebase(path: Column, top: str) -> Column:
    """Path relative to ``top``, which itself becomes ``'.'``."""
    if top in ("", "."):
        return path
    return F.when(path == top, ".").otherwise(F.substr(path, F.lit(len(top) + 2)))


def unbase(path: Column, top: str) -> Column:
    """The inverse of ``rebase``."""
    if top in ("", "."):
        return path
    return F.when(path == ".", top).otherwise(F.concat(F.lit(top + "/"), path))


def published(path: Column) -> Column:
    return F.when(path == "", ".").otherwise(path)


def published_parent(path: Column, is_dir: Column) -> Column:
    """Top-level directories hang on ``'.'``, top-level files and the root on ``''``."""
    up = parent(path)
    return F.when(is_dir & (up == "") & (path != ""), ".").otherwise(up)


def uri(root: Column, path: Column) -> Column:
    return F.when(path.isin("", "."), root).otherwise(F.concat(root, F.lit("/"), path))
