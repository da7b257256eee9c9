"""Schemas, readers, sinks and the validated feature-table store."""
