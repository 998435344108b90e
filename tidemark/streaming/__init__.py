"""The ordered rules on streams of frames."""
