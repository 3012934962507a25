"""Operators that go beyond single DataFrame calls: nearest neighbours, graphs, changes to tables, locks."""
