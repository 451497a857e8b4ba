"""Labels, splits and parts of file paths.

Three label extractors are kept apart on purpose: they differ in the folders they skip, in
case and in what they give when nothing is left.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the label rules.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")
SEED_FOLDERS = ("train", "test", "color", "grayscale", "segmented")
SPLIT_FOLDERS = ("train", "test", "val", "validation")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def relative(path: Column | str, root: Column | str) -> Column:
    """path without root and the slash after it; null if path is not under root."""
    p, r = _c(path), F.concat(F.rtrim(_c(root), F.lit("/")), F.lit("/"))
    return F.when(F.startswith(p, r), F.substr(p, F.length(r) + 1))


def under(path: Column | str, root: str) -> Column:
    """`relative` of a path as Spark gives it, to a root that may be written with or without its scheme."""
    return relative(F.regexp_replace(_c(path), r"^[a-z0-9+.-]+:/*", "/"), F.lit(re.sub(r"^[a-z0-9+.-]+:/*", "/", root)))


def parts(path: Column | str) -> Column:
    """Components of a path, without empty ones."""
    return F.filter(F.split(_c(path), "/"), lambda x: x != "")


def suffix(path: Column | str) -> Column:
    """Lower-case suffix with its dot; empty for names without one and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(_c(path), r"[^/.][^/]*(\.[^./]+)$", 1))


def is_image(path: Column | str) -> Column:
    return suffix(path).isin(*IMAGE_SUFFIXES)


def _first_outside(path: Column | str, skip: tuple[str, ...], fold: bool) -> Column:
    return F.try_element_at(F.filter(parts(path), lambda x: ~(F.lower(x) if fold else x).isin(*skip)), F.lit(1))


def label_profile(path: Column | str) -> Column:
    """Extractor A: the first component that is no seed folder in any case, else the first component."""
    return F.coalesce(_first_outside(path, SEED_FOLDERS, True), F.try_element_at(parts(path), F.lit(1)))


def label_inspect(path: Column | str) -> Column:
    """Extractor B: the first component that is no split folder in any case, else `unknown`."""
    return F.when(_c(path).isNotNull(), F.coalesce(_first_outside(path, SPLIT_FOLDERS, True), F.lit("unknown")))


def label_manifest(path: Column | str, mode: str = "split") -> Column:
    """Extractor C: mode flat takes the first component; mode split the first that is no seed folder, in exact case; else `unknown`."""
    if mode == "flat":
        found = F.try_element_at(parts(path), F.lit(1))
    elif mode == "split":
        found = _first_outside(path, SEED_FOLDERS, False)
    else:
        raise ValueError("mode must be flat or split")
    return F.when(_c(path).isNotNull(), F.coalesce(found, F.lit("unknown")))


def infer_split(path: Column | str) -> Column:
    """train, val or test from the first component that names a split in any case; else null."""
    hit = F.try_element_at(F.filter(F.transform(parts(path), lambda x: F.lower(x)), lambda x: x.isin(*SPLIT_FOLDERS)), F.lit(1))
    return F.when(hit == "validation", "val").otherwise(hit)


def tail(path: Column | str, n: int = 2) -> Column:
    """The last n components, whether / or \\ separates them, joined by /."""
    p = F.split(_c(path), r"[\\/]")
    return F.array_join(F.slice(p, -F.least(F.size(p), F.lit(n)), n), "/")


def archive_target(entry: Column | str, prefix: str) -> Column:
    """What remains of an archive entry after a prefix, without slashes at its ends, so that it is a relative path; null for other entries,
    folders, files directly under the prefix, and paths that lead out of the target."""
    e = F.translate(_c(entry), "\\", "/")
    rest = F.regexp_replace(F.substr(e, F.lit(len(prefix) + 1)), "^/+|/+$", "")
    inside = F.contains(rest, F.lit("/")) & ~F.array_contains(F.split(rest, "/"), "..")
    return F.when(F.startswith(e, F.lit(prefix)) & ~F.endswith(e, F.lit("/")) & inside, rest)


def comma_list(x: Column | str) -> Column:
    """Trimmed non-empty entries of a comma-separated list."""
    return F.filter(F.transform(F.split(_c(x), ","), lambda y: F.trim(y)), lambda y: y != "")
