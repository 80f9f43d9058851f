"""Rule documents compiled to plans."""
