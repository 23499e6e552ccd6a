"""Event-sourced task queues on Spark: an append-only log, and all queue state derived from it."""
