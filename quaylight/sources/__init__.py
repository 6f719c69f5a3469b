"""Landed files in, tables out. Network fetching is not part of this library."""
