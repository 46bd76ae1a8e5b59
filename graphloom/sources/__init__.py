"""Readers and writers: text, project files, markup, snapshots, and projections of the driver tables."""
