"""Training-data operators.

Nothing outside this package imports it; of the rest it imports ``sources.storage``.
On a cluster, ship the package with ``--py-files`` or an installed wheel.
"""
