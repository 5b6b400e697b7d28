"""sources of the audio-frame engine."""
