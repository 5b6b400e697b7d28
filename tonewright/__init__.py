"""Audio-frame analytics on Spark."""
