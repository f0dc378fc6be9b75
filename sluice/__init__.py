"""sluice: event-time dataflows as Spark DataFrames."""
