"""svcops: service-cost analytics as PySpark DataFrame jobs.

Entry points: :func:`svcops.plans.registry.queries` (key -> job) and
:class:`svcops.sources.catalog.Tables` (raw / clean tables of a data folder).
"""

__version__ = "0.1.0"
