"""Training-data operators: ten text, vector and archive operators and their registered queries.

Nothing else in the package imports this folder; ``__spark_entry__.py`` adds its queries when it is present.
"""
