"""Record tables on Spark: load, validate, find, delete, append, replay, render and export."""
