"""Readers for the feeds and writers for tables and CSV."""

from meterflow.sources.climate import explode_measures, measure_rejects, read_measures  # noqa: F401
from meterflow.sources.files import (  # noqa: F401
    read_counter_csv,
    read_counter_pages,
    read_day_files,
    read_meter_csv,
    read_meter_replies,
    read_meter_xml,
)
from meterflow.sources.tables import (  # noqa: F401
    append,
    csv_lines,
    ensure_table,
    load_series,
    overwrite,
    power_stats_rows,
    scan,
    stats_all,
    water_stats_rows,
    write_csv,
)
