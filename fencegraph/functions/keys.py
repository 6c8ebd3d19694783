"""Ids that cannot run into each other.

Mentions and chunks are told apart by (work_id, id), the id being made of chapter and ordinal, two 32-bit numbers that fit
a 64-bit one side by side. Node and edge ids are unique over all works; a work that outgrows its share of numbers is an
error, never a silent clash.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = 1 << 28  # numbers of a work; leaves 3.4e10 works
EDGES = 1 << 33  # numbers of a tier of a work; leaves 2.6e8 works
TIERS = 4


def in_work(chapter: Column, ordinal: Column) -> Column:
    """Id within a work, in the order of chapter and ordinal."""
    return chapter.cast("long") * F.lit(1 << 31) + ordinal.cast("long")


def node_id(work: Column, no: Column) -> Column:
    return work * F.lit(NODES) + _below(no, NODES)


def edge_id(work: Column, tier: int, no: Column) -> Column:
    return work * F.lit(EDGES * TIERS) + F.lit(tier * EDGES) + _below(no, EDGES)


def _below(no: Column, limit: int) -> Column:
    return F.when(no < limit, no).otherwise(F.raise_error(F.lit(f"a work needs more than {limit} ids")).cast("long"))
