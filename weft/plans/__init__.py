"""Composite plans: graph build, reports, log analytics, registered queries."""
