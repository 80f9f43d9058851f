"""Operators for preparing training corpora.

Ten independent operators over ``documents``, ``benchmark``, ``labels`` and
``pages``; nothing else in the library imports this subpackage.
"""
