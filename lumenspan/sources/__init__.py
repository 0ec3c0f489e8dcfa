"""Readers and writers: subtitles, JSON documents, WAV audio, and the carrier views of the test tables."""
