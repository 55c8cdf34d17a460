"""The registered queries: each operator on feeds derived from the test tables,
with the SQL that must give the same result."""
