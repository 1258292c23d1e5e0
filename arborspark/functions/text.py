"""Scalar helpers: user names, run-name stems, operations, globs, sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Storage classes by id (fixed values): 1 standard, 2 nearline, 3 coldline, 4 archive; 0 is unknown.
GCS_CLASSES = {"STANDARD": 1, "NEARLINE": 2, "COLDLINE": 3, "ARCHIVE": 4}
S3_CLASSES = {
    "STANDARD": 1, "REDUCED_REDUNDANCY": 1, "INTELLIGENT_TIERING": 1, "OUTPOSTS": 1, "STANDARD_IA": 2, "ONEZONE_IA": 2, "GLACIER_IR": 3,
    "GLACIER_INSTANT_RETRIEVAL": 3, "GLACIER": 4, "DEEP_ARCHIVE": 4,
}
#: How a run name's hash and resume mark look (fixed values).
HASH, RESUME = "-[0-9a-f]{6,8}$", r"[_-]resume\d+.*$"


def lookup(values: dict, key: Column) -> Column:
    """A literal map's value, null for other keys."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def sanitize_username(raw: Column) -> Column:
    """Lower-case name before any ``@``, other characters as single dashes; an empty outcome raises."""
    name = F.lower(F.substring_index(F.trim(raw), "@", 1))
    name = F.trim(F.regexp_replace(name, "[^a-z0-9_-]+", "-"), F.lit("-"))
    return F.when(raw.isNull(), None).when(name == "", F.raise_error(F.concat(F.lit("empty user name: "), raw))).otherwise(name)


def without_hash(name: Column) -> Column:
    return F.regexp_replace(name, HASH, "")


def stem(name: Column) -> Column:
    """A run name without its hash, then without its resume mark, then without trailing marks."""
    return F.rtrim(F.regexp_replace(without_hash(name), RESUME, ""), F.lit("_-"))


def normalize_op(method: Column, operation: Column) -> Column:
    """LIST, GET, PUT, HEAD, DELETE or OTHER, case-sensitive. The logged operation's first word tells, and ``..._BUCKET`` is a listing; the
    method speaks where the operation has not by its turn. Of POST operations only two write an object."""
    logged = F.coalesce(operation, F.lit(""))

    def is_(verb: str) -> Column:
        return logged.startswith(verb) | F.coalesce(method == verb, F.lit(False))

    lists = logged.startswith("LIST") | (logged.endswith("BUCKET") & (F.length(logged) > len("BUCKET")))
    return (
        F.when(lists, "LIST").when(is_("GET"), "GET").when(is_("PUT") | logged.isin("POST_Object", "POST_Uploads"), "PUT")
        .when(is_("HEAD"), "HEAD").when(is_("DELETE"), "DELETE").otherwise("OTHER")
    )


def glob_regex(pattern: str) -> str:
    """A glob (``*``, ``?``, ``[...]``) as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end
        else:
            out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        i += 1
    return f"^(?s:{out})$"


def split_glob(pattern: str) -> tuple[str, str]:
    """The folder without wildcards that a glob starts with, and the rest."""
    parts = pattern.split("/")
    k = next((i for i, p in enumerate(parts) if re.search(r"[*?\[]", p)), len(parts) - 1)
    return "/".join(parts[:k]), "/".join(parts[k:])


def format_size(size: Column, base: int = 1024) -> Column:
    """Human-readable bytes; ``base`` 1024 gives KiB steps named K, M, G, 1000 gives kB steps."""
    names = ["B", "K", "M", "G", "T", "P"] if base == 1024 else ["B", "kB", "MB", "GB", "TB", "PB"]
    out = F.concat(F.format_number(size / float(base**5), 1), F.lit(f" {names[5]}"))
    for k in range(4, 0, -1):
        out = F.when(F.abs(size) < base ** (k + 1), F.concat(F.format_number(size / float(base**k), 1), F.lit(f" {names[k]}"))).otherwise(out)
    return F.when(F.abs(size) < base, F.concat(size.cast("string"), F.lit(f" {names[0]}"))).otherwise(out)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds, floored; works for both timestamp types."""
    return F.unix_seconds(ts.cast("timestamp"))


def epoch_day(ts: Column) -> Column:
    return F.floor(epoch_seconds(ts) / 86400).cast("int")


def round_day(seconds: Column) -> Column:
    """The nearest epoch day; halves go to the even one."""
    return F.rint(seconds / 86400).cast("int")


def day_text(seconds: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """Epoch seconds as text, in the session's time zone."""
    return F.date_format(F.timestamp_seconds(seconds), pattern)


def encode_scan(scan: Column) -> Column:
    """``2026-08-17T1944`` as ``260817-1944``, ``2026-08-17`` as ``260817``; anything else stays."""
    shape = r"^\d{2}(\d{2})-(\d{2})-(\d{2})(?:T(\d{2})(\d{2}))?$"
    part = lambda k: F.regexp_extract(scan, shape, k)
    time = F.when(part(4) != "", F.concat(F.lit("-"), part(4), part(5))).otherwise("")
    return F.when(scan.rlike(shape), F.concat(part(1), part(2), part(3), time)).otherwise(scan)


def decode_scan(code: Column) -> Column:
    """The scan id, or the start of scan ids, that a code stands for; null for what is no code."""
    shape = r"^(\d{2})(\d{2})(\d{2})(?:-(\d{2})(\d{2})?)?$"
    part = lambda k: F.regexp_extract(code, shape, k)
    time = F.when(part(4) != "", F.concat(F.lit("T"), part(4), part(5))).otherwise("")
    return F.when(code.rlike(shape), F.concat(F.lit("20"), part(1), F.lit("-"), part(2), F.lit("-"), part(3), time))
