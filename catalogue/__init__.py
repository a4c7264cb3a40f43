"""The registered queries, each over whole test tables, and the SQL they must agree with."""
