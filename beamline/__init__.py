"""beamline: broadcast-stream analytics and training-data preparation on PySpark."""
