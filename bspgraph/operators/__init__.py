"""Relational building blocks of a superstep."""
