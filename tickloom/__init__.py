"""PySpark library for ordered numeric sequences such as price ticks."""
