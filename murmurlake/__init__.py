"""Spark jobs for the data work around large speech, audio and text collections."""
