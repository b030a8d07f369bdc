"""The window over streams."""

from keyhold.streaming.observe import admit_stream, stream_held, stream_stats

__all__ = ["admit_stream", "stream_held", "stream_stats"]
