"""Metadata-driven extraction: control tables, runs, reconciliation and reports."""
