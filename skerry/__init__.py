"""Streaming and batch analytics over keyed, time-stamped chunks and their transcripts, on Spark."""
