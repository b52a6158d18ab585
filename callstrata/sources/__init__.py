"""Readers and writers for call logs, holiday lists, result files and reports."""
