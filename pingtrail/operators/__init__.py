"""User-level operators: DataFrame in, DataFrame out."""

from pingtrail.operators.diel import (  # noqa: F401
    hour_bin, hour_label, rose_counts, rose_detections, rose_resident_hours, tag_roses, write_roses,
)
from pingtrail.operators.events import (  # noqa: F401
    bins_with_events, event_ids, hour_bins, hourly_bins, hourly_residency, resident_hours, residency_events, sorted_events,
)
from pingtrail.operators.movement import (  # noqa: F401
    movement_base, movement_legs, movement_station_counts, sorted_legs,
)
from pingtrail.operators.range_test import (  # noqa: F401
    fit_range, local_schedule, range_by_distance, range_curve, range_detections, range_hourly, range_thresholds,
    schedule_hours, window_lookup, with_expected,
)
from pingtrail.operators.residency import (  # noqa: F401
    expand_days, mean_residency, monthly_days, monthly_presence, stacked_totals, unique_tags,
)
from pingtrail.operators.tidy import (  # noqa: F401
    any_missing, as_points, distinct_values, frequency, missing_cells, numeric_summary, six_number, station_counts,
    tidy_detections,
)
from pingtrail.operators.timeline import abacus, tag_ranks  # noqa: F401
