"""Whole plans: fixtures, registered queries and their SQL twins."""
