"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from pingtrail.functions.time import (  # noqa: F401
    US_PER_DAY,
    US_PER_HOUR,
    US_PER_SEC,
    diff_us,
    epoch_us,
    floor_time,
    from_epoch_us,
    month_label,
    parse_date_time,
    parse_dmy_hm,
    round_ratio_half_up,
    shift_zone,
    to_ntz,
)
from pingtrail.functions.text import clean_name, clean_names, parse_number, trailing_digits  # noqa: F401
