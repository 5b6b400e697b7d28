"""plans of the audio-frame engine."""
