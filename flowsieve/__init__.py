"""Spark jobs for labelled flow tables: evidence fusion, training, evaluation and roll-ups."""
