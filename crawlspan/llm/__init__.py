"""Operators on very large text and number collections. Nothing else in the library imports this subpackage."""
