"""Scalar functions as Columns; built-in expressions only, but for the byte-bounded cut and the float codec."""
