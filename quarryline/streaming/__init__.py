"""Streaming forms of the batch aggregations."""

from quarryline.streaming.sums import streaming_sum

__all__ = ["streaming_sum"]
