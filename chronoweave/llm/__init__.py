"""Operators of a training-data pipeline (scoring, packing, de-duplication, search, filtering, mixing).

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its
queries only if it can be imported.
"""
