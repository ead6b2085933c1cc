"""The registered queries, the tables they run on, and their SQL twins."""
