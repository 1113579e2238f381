"""Registered queries over the benchmark tables, with their plain-SQL twins."""
