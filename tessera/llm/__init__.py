"""Training-data operators for very large corpora.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own general interface; ``queries`` binds them to the standard tables.
"""
