"""Queries that bind the operators to tables, with SQL that gives the same rows."""
