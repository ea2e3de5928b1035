"""Content analytics on Spark: discovery, cleaning, dedup, chunking, classification, series state and sinks as DataFrame operators."""
