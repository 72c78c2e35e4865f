"""Registered queries, each with the SQL that gives the same result where there is one."""
