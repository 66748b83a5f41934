"""Reusable physical-plan shapes: chunked ordered windows and gap buckets."""

from pingtrail.plans.sequence import lead_columns, number_events, number_rows, sessionize  # noqa: F401
