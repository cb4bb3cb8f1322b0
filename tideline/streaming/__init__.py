"""Live series: the same recurrences and windows on Structured Streaming."""
