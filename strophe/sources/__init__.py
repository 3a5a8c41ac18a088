"""Readers and writers: timed-lyric files, archives, index lines and the versioned catalogue."""
