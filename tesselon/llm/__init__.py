"""Operators that prepare large text corpora for language-model training.

Nothing outside this subpackage imports it.  Each module is one operator; ``queries`` maps the
operators onto the tables of a data folder.
"""
