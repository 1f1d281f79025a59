"""Readers of reports, configuration, files and source code."""
