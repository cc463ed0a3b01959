"""Readers that turn corpora and tool reports into tables, and the sinks."""
