"""The pipeline: features per source, assembly, encodings, models, ensemble, evaluation, analytics."""
