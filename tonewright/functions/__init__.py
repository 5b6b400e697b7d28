"""functions of the audio-frame engine."""
