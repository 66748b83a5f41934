"""Sources and sinks: delimited text, parquet stages, partitioned exports, and
the adapter from the driver's test tables to detection-shaped tables."""

from pingtrail.sources.delimited import read_delimited  # noqa: F401
from pingtrail.sources.geojson import read_geojson, write_geojson  # noqa: F401
from pingtrail.sources.stages import load_stage, save_stage, write_partitioned  # noqa: F401
