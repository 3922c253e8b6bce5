"""Readers of the outside formats: payloads, transcripts, commit listings, paths, prices."""
