"""Training-data operators: ten corpus stages plus their registered queries.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only where the folder exists.
"""
