"""From a corpus to a written manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import SEED, TRAINING_GENERATORS
from ..operators.filters import drop_excluded, filter_generators
from ..operators.integrity import duplicate_members, integrity_report, problem_files, unreadable, wrong_size
from ..operators.splits import (
    assign_splits, ood_split, ood_split_by_family, reserve_fusion_calibration,
)
from ..sources.sinks import report_json, write_manifest, write_table


def split_for_protocol(entries: DataFrame, protocol: str = "standard", seed=SEED,
                       reserve: bool = True) -> DataFrame:
    """Splits of one protocol: ``standard``, ``ood`` or ``ood_family``."""
    if protocol == "standard":
        return assign_splits(filter_generators(entries, TRAINING_GENERATORS), seed)
    split = assign_splits(entries, seed)
    if protocol == "ood_family":
        return drop_excluded(ood_split_by_family(split))
    if protocol == "ood":
        kept = drop_excluded(ood_split(split))
        return reserve_fusion_calibration(kept, seed) if reserve else kept
    raise ValueError(f"unknown protocol: {protocol}")


def prepare(entries: DataFrame, manifest_path: str, report_path: str, protocol: str = "standard",
            seed=SEED, check_duplicates: bool = True, reserve: bool = True, width: str | None = None,
            height: str | None = None, expected: int = 0) -> bool:
    """Check, split, write. Returns whether the corpus is sound; problems stay in the manifest.

    Beside the report, ``<report>_files`` lists corrupted and wrong-sized files and ``<report>_duplicates`` every copy of a
    content that occurs more than once. ``width`` and ``height`` name columns to hold against ``expected``.
    """
    report = integrity_report(entries, width, height, expected, check_duplicates=check_duplicates)
    write_table(report_json(report), report_path, "text")
    size_bad = wrong_size(F.col(width), F.col(height), expected) if width else F.lit(False)
    files = problem_files(entries, unreadable(entries), size_bad)
    write_table(files.select("sample_id", "problem"), f"{report_path}_files", "parquet")
    if check_duplicates:
        write_table(duplicate_members(entries), f"{report_path}_duplicates", "parquet")
    write_manifest(split_for_protocol(entries, protocol, seed, reserve), manifest_path)
    return bool(entries.sparkSession.read.text(report_path).filter("value like '%\"ok\":true%'").count())
