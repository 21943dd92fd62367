"""Derived tables and the registered queries over them."""
