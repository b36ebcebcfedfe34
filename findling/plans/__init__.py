"""Derived tables, registered queries and plan shapes."""
