"""Training-data operators. Nothing outside this subpackage imports it.

Every operator takes DataFrames and column names, returns a lazy DataFrame and
leaves unknown input columns alone. ``queries.py`` holds the thin ``opN_*``
queries over the tables of a scale-factor folder.
"""
