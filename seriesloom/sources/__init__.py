"""Readers, page-table extraction, sinks and the versioned keyed store."""
