"""Machine-hour analytics on Spark: typed layers, overlays in time, readers, models and incremental ingest."""
