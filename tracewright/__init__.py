"""tracewright: Spark-first analytics for multichannel traces and their cleaned variants."""

__version__ = "0.1.0"
