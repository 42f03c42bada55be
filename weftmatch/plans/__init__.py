"""Queries over the test tables, and SQL that checks them."""
