"""Per-work knobs as data: a table of overrides joined on work_id, defaults where a knob is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: default knobs ---
DEFAULTS: dict[str, object] = {
    "dehyphenate": True, "single_newline_is_paragraph": False,
    "chapter_mode": "auto", "heading_regex": r"^\s*chapter\s+\d+\b.*$", "delimiter": "\n---\n", "first_chapter_number": 1,
    "max_chars": 1500, "overlap_sentences": 1,
    "threshold": 0.4, "window_chars": 250, "min_cooccurrences": 1, "max_candidate_pairs": 60,
    "merge_self_reference": False, "pov_character": "",
}
SCHEMA = (
    "dehyphenate boolean, single_newline_is_paragraph boolean, chapter_mode string, heading_regex string, delimiter string, "
    "first_chapter_number int, max_chars int, overlap_sentences int, threshold double, window_chars int, min_cooccurrences int, "
    "max_candidate_pairs int, merge_self_reference boolean, pov_character string"
)


def parse_knobs(raw: DataFrame, column: str = "knobs") -> DataFrame:
    """JSON knob documents -> one column per knob (null where absent)."""
    return raw.withColumn("__k", F.from_json(column, SCHEMA)).select("work_id", "__k.*")


def with_knobs(df: DataFrame, knobs: DataFrame | None) -> DataFrame:
    """Add every knob to the rows of ``df`` by work, default where missing.

    The table of overrides has one row per configured work; Catalyst broadcasts it if its size allows.
    """
    if knobs is None:
        return df.select("*", *[F.lit(v).alias(k) for k, v in DEFAULTS.items()])
    j = df.join(knobs, "work_id", "left")
    return j.select(*df.columns, *[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in DEFAULTS.items()])
