"""Operators over timelines, transcripts, signals and frames."""
