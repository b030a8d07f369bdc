"""Batch operators of the key window."""

from keyhold.operators.admission import admit, admitted_at, departures, reuse_distance, seen_asof
from keyhold.operators.sketch import KeySketch, flag_seen_pruned, seen_only_pruned, unseen_only_pruned
from keyhold.operators.snapshot import advance, described, flag_seen, fresh, held_after, marked_for_stats, retained_keys, seen_only, snapshot, stats, tallied, unseen_only

__all__ = [
    "KeySketch", "admit", "admitted_at", "advance", "departures", "described", "flag_seen", "flag_seen_pruned", "fresh", "held_after",
    "marked_for_stats", "retained_keys", "reuse_distance", "seen_asof", "seen_only", "seen_only_pruned", "snapshot", "stats", "tallied",
    "unseen_only", "unseen_only_pruned",
]
