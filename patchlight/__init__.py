"""Code-change analytics on Spark: sources, operators, functions, plans and streaming extensions."""
