"""Training-data operators: ten distributed document operators and their registered queries.

Nothing else in ``transloom`` imports this subpackage.
"""
