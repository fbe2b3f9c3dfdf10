"""Column expressions whose null, tie and rounding rules differ from Spark's built-in ones."""
