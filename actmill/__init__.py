"""Spark jobs that turn structured text into searchable chunks, rank them and measure the ranking."""
