"""Statistics over streams of samples."""

from tidewell.streaming.incremental import incremental, samples

__all__ = ["incremental", "samples"]
