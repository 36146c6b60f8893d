"""Registered queries over the shared test tables, and the same results in plain SQL."""
