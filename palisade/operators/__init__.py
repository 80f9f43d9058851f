"""Detection, decision, redaction and restoring."""
