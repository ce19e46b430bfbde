"""Reusable relational operators, each a composition of DataFrame operations."""

from dxlens.operators.closure import descendant_closure
from dxlens.operators.dyadic import interval_join
from dxlens.operators.grouping import (argmin_then_max, fill_from_group_min, flag_members, flag_repeats,
                                       latest_per_group)
from dxlens.operators.intervals import hot_key_join
from dxlens.operators.matching import full_match, match_stats

__all__ = ["latest_per_group", "argmin_then_max", "flag_repeats", "flag_members", "fill_from_group_min",
           "hot_key_join", "interval_join", "descendant_closure", "full_match", "match_stats"]
