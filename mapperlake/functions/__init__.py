"""Pure text functions: SQL tokens, SQL trees, inline parameters, expressions."""
