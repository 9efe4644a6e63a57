"""Water-quality analytics over satellite pixels, scenes and field sensors, written as Spark jobs."""

__version__ = "0.1.0"
