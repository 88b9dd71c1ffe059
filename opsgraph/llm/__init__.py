"""Operators for building language-model training corpora at scale.

Nothing outside this package imports it.  ``entries`` registers its queries.
"""
