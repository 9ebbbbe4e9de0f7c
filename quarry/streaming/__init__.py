"""Streaming entry points.

The reference has no streaming code; the one operator whose semantics carry
over unchanged to an unbounded input is the event-log summary (E1): its
aggregates (min, max, conditional count) are all incrementally mergeable, so
Structured Streaming can maintain them in its state store.
"""
from quarry.streaming.events import event_summary_stream  # noqa: F401
