"""Change-history views over the given tables, the registered queries and their SQL counterparts."""
