"""Training-data pipeline operators over document and page tables.

Nothing outside this subpackage imports it.
"""
