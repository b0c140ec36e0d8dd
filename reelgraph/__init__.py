"""Spark batch and streaming jobs for a media catalog and its community."""
