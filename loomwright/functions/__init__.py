"""Array, mapping, text and identifier helpers for columns and for plain values."""
