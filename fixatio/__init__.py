"""Attention analytics on event-sampled gaze data, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
