"""kiln — Spark-native preparation, feature assembly, scoring and reporting
for product-quality regression data.

Every operator is either ``Column -> Column`` (``kiln.functions``) or
``DataFrame -> DataFrame`` (``kiln.operators``); sources and sinks live in
``kiln.sources``, end-to-end jobs in ``kiln.plans`` and streaming wiring in
``kiln.streaming``.
"""

__version__ = "0.1.0"

# Ship kiln's own code inside pickled UDFs and batch functions, so Python
# workers need no installed copy of the package (no --py-files step).
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
