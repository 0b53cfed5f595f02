"""Column expressions and, where a rule is a scan of a sentence, plain Python functions with their UDFs."""
