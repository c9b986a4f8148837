"""Composite jobs, the served views and the registered queries."""
