"""Input tables, market-shaped views over them, and sinks."""
