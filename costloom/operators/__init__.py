"""DataFrame -> DataFrame operators: no reads or writes of tables."""
