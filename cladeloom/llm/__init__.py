"""Operators for preparing language-model training text.

One module for each operator; ``registry`` holds their driver queries and
the SQL twins. Nothing outside this folder imports it.
"""
