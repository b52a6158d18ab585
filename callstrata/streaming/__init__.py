"""Incremental jobs over landed files: daily counts, quarantine, request rates, blocks and sessions."""
