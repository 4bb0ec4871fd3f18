"""Spark-native analytics for time-stamped, speaker-attributed conversation transcripts."""
