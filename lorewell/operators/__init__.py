"""DataFrame -> DataFrame operators: lazy, no collect."""
