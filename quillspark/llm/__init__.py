"""Training-data pipeline operators (language id, extraction, dedup, packing, ...).

Nothing else in the library imports this subpackage.
"""
