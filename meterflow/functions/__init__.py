"""Column expressions: time, numbers and units."""

from meterflow.functions.numbers import (  # noqa: F401
    is_nodata,
    null_if_blank,
    row_max,
    row_sum,
    unit_factor,
    value_or_zero,
)
from meterflow.functions.timing import (  # noqa: F401
    bucket,
    day_key,
    from_ns,
    ns_of_seconds,
    parse_ts,
    step_micros,
    to_local,
    to_ns,
    to_utc,
)
