"""Derived input tables, registered queries and their SQL oracles."""
