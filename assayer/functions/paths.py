"""Path column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def posix_path(raw: Column) -> Column:
    r"""``C:\a\b`` becomes ``/mnt/c/a/b``; posix paths pass through."""
    text = F.replace(F.trim(raw), F.lit("\\"), F.lit("/"))
    drive = F.regexp_extract(text, r"^(.):", 1)
    return F.when(F.length(drive) > 0,
                  F.concat(F.lit("/mnt/"), F.lower(drive), F.substring(text, 3, 1 << 20))
                  ).otherwise(text)


def segments(path: Column) -> Column:
    return F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")


def segment(path: Column, index: int) -> Column:
    """Path segment; negative counts from the end. NULL when there is none."""
    return F.try_element_at(segments(path), F.lit(index))


def basename(path: Column) -> Column:
    return segment(path, -1)


def suffix(path: Column) -> Column:
    """Final suffix with its dot, lower case; empty when there is none."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]+$", "")


def mask_paths(path: Column, root: str) -> list[Column]:
    """The two sibling mask paths ``<set>_shadow`` and ``<set>_object``."""
    tail = [segment(path, -3), segment(path, -2), segment(path, -1)]
    return [
        F.concat_ws("/", F.lit(root), F.concat(segment(path, -4), F.lit(f"_{kind}")), *tail)
        .alias(f"{kind}_path")
        for kind in ("shadow", "object")
    ]
