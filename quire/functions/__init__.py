"""Column functions and the few pandas UDFs that have no built-in form."""
