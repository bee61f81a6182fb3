"""Operators for preparing training text at cluster scale.

Every module here stands alone beside the change-data-capture engine: nothing
outside this subpackage imports it.
"""
