"""pulseweave: event detection over streams of short posts, as Spark jobs."""

__version__ = "0.1.0"
