"""meterline - usage and cost analytics for AI-tool turn logs, on Spark."""

__version__ = "0.1.0"
