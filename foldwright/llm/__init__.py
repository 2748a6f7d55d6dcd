"""Operators for preparing training data at corpus scale.

Nothing outside this package imports it.  Each module holds one operator with a
general interface; ``queries`` registers the thin ``opN_<name>`` queries.
"""
