"""Detectors: one column expression per file family.

Every detector maps the columns of one file row to ``array<finding>``. Nothing
here joins, explodes or shuffles; ``operators.scan`` runs all of them in one
narrow pass over the ``files`` table.
"""
