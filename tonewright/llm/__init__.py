"""Training-data operators: ten stages of a corpus pipeline as Spark jobs.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds its
queries only where it can be imported.
"""
