"""Structured Streaming entry points for the operators that are row-local or
keyed aggregates (the reference itself has no streams; these let the same
plans run continuously over arriving files)."""
