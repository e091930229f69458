"""Training-data operators (tokenising, scoring, filtering, deduplicating, packing).

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` holds the thin registered
queries that apply them to whole tables.
"""
