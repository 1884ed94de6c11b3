"""pinax: panel price analytics on Spark.

Operators are ``DataFrame -> DataFrame`` functions in ``pinax.operators``,
column expressions in ``pinax.functions``, readers and writers in
``pinax.sources``, the reference's end-to-end steps in ``pinax.plans.stages``
and the query catalogue in ``pinax.plans.catalog``.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions and classes by value in task closures.

    The per-task decoders (HTML pages, workbooks) then reach Python workers
    inside the task itself, so executors need no installed copy of the package
    (``--py-files`` or an installed wheel work as well).
    """
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover - PySpark is a hard requirement elsewhere
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
