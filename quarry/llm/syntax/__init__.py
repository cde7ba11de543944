"""Hand-written parsers: recursive descent for statements, precedence climbing for expressions."""
