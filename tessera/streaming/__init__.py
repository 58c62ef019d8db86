"""Structured Streaming: frames for each micro-batch, and linked streams with state."""

from .sinks import frame_sink, linked_stream  # noqa: F401
