"""Scans: files, generated relations, directory listings, and the journal of a stream."""
