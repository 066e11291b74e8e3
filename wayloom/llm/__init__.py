"""Operators on text corpora: encoding by public tokenizers, mixing of sources, and look-alike text. Nothing else in the library needs this
subpackage.
"""
