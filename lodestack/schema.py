"""Columns of the tables that operators exchange, as DDL."""

ACCESS = "ts string, kind string, ids array<string>"
LINKS = "a string, b string, relation string, created string, agent string"
