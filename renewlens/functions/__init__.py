"""Column-expression helpers. Everything here compiles to built-in Spark functions."""
