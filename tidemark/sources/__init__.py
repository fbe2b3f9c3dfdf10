"""CSV input with explicit types, the feature store and CSV output."""
