"""operators of the audio-frame engine."""
