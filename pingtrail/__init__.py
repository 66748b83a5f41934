"""pingtrail: acoustic-telemetry analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame; nothing is collected
to the driver except scalar model parameters.  Timestamps are handled as
``timestamp_ntz`` wall-clock values in UTC, with arithmetic on epoch
microseconds, so results do not depend on ``spark.sql.session.timeZone``.
"""

__version__ = "0.1.0"
