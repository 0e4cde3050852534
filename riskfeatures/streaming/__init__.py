"""Streaming: intentionally empty.

The modelled workload has no streams, watermarks, event-time windows or
stateful operators — every source is a full batch read — so there is nothing
to express with Structured Streaming here.  Point-in-time correctness (the
part that looks like "state over time") is handled in batch by the as-of
operators in ``riskfeatures.operators.pit``.
"""
