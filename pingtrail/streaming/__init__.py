"""Structured Streaming form of the residency gap rule (detections arriving
continuously instead of as a finished file)."""

from pingtrail.streaming.residency import residency_sessions  # noqa: F401
