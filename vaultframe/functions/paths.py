"""Path expressions: selection scope, containment, sanitising, globs, volume mapping."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that no scan descends into. Fixed values.
ALWAYS_EXCLUDED = ("pagefile.sys", "hiberfil.sys", "swapfile.sys", "System Volume Information", "$RECYCLE.BIN")
PLACEHOLDER_BITS, HIDDEN, SYSTEM = 0x00040000 | 0x00400000, 0x2, 0x4


def in_scope(path: Column, selected: Sequence[str] | None) -> Column:
    """Equal to, below or above a selected path; no selection selects all."""
    if selected is None:
        return F.lit(True)
    hit = F.lit(False)
    for s in selected:
        hit = hit | (path == s) | path.startswith(f"{s}/") | F.lit(s).startswith(F.concat(path, F.lit("/")))
    return hit


def is_contained(path: Column) -> Column:
    """Whether a relative path stays below its target: not rooted, never above the start."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    depth = F.aggregate(parts, F.lit(0), lambda d, p: F.when(d < 0, d).when(p.isin("", "."), d).when(p == "..", d - 1).otherwise(d + 1))
    return ~path.rlike(r"^([A-Za-z]:|[\\/])") & (depth > 0)


def root_segment(name: Column) -> Column:
    """The node name of a source root: no separators or colons, "root" if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(name, r"[\\/]+$", ""), r"[:\\/]", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("root"))


def root_of_source(path: Column) -> Column:
    """root_segment of a path's last part; of the whole path if it is a drive."""
    bare = F.regexp_replace(path, r"[\\/]+$", "")
    return root_segment(F.element_at(F.split(bare, r"[\\/]"), -1))


def display_name(path: Column) -> Column:
    """The last part of a repository's path."""
    bare = F.regexp_replace(path, r"[\\/]+$", "")
    last = F.element_at(F.split(bare, r"[\\/]"), -1)
    return F.when(last == "", bare).otherwise(last)


def ancestors(path: Column) -> Column:
    """The path's own prefixes, from its first part to itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def pack_path(pack_id: Column) -> Column:
    return F.concat(F.lit("data/"), F.substring(pack_id, 1, 2), F.lit("/"), pack_id, F.lit(".pack"))


def glob_regex(pattern: str) -> str:
    """A glob relative to the root: ** spans directories, * and ? stay in one; case-insensitive."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return f"(?is)^{out}$"


def excluded(relative: Column, name: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Whether a scan skips an entry, and with it all below."""
    out = F.lower(name).isin([n.lower() for n in ALWAYS_EXCLUDED])
    if include or exclude:
        hit = F.lit(False)
        for p in include or ("**/*",):
            hit = hit | relative.rlike(glob_regex(p))
        for p in exclude:
            hit = hit & ~relative.rlike(glob_regex(p))
        out = out | ~hit
    return out


def ends_with_any(name: Column, endings: Sequence[str]) -> Column:
    low, hit = F.lower(name), F.lit(False)
    for e in endings:
        hit = hit | low.endswith(e.lower())
    return hit


def is_placeholder(attributes: Column) -> Column:
    return attributes.bitwiseAND(PLACEHOLDER_BITS) != 0


def is_browsable(attributes: Column) -> Column:
    return attributes.bitwiseAND(HIDDEN | SYSTEM) != (HIDDEN | SYSTEM)


def map_path(path: Column, devices: Mapping[str, str]) -> Column:
    """A path on a volume, such as ``D:\\``, to its device; others as they are."""
    out = path
    for root, device in devices.items():
        glue = "" if device.endswith("\\") else "\\"
        out = F.when(F.lower(path).startswith(root.lower()), F.concat(F.lit(device + glue), F.substring(path, len(root) + 1, 2**31 - 1))).otherwise(out)
    return out


def unmap_path(path: Column, devices: Mapping[str, str]) -> Column:
    """The inverse; the first device that the path begins with counts."""
    out = path
    for root, device in reversed(list(devices.items())):
        rest = F.regexp_replace(F.substring(path, len(device) + 1, 2**31 - 1), r"^\\+", "")
        out = F.when(F.lower(path).startswith(device.lower()), F.concat(F.lit(root if root.endswith("\\") else root + "\\"), rest)).otherwise(out)
    return out
