"""The registered queries and, where SQL can say it, the SQL they must equal."""
