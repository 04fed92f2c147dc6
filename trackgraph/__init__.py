"""PySpark jobs for telemetry, map networks and routing."""
