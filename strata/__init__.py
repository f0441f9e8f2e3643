"""strata: multi-label classification data work as Spark DataFrame jobs.

Subpackages: ``sources`` (readers/writers), ``functions`` (column expressions),
``operators`` (DataFrame -> DataFrame operators), ``plans`` (fixtures, query
catalog and DuckDB oracle), ``streaming`` (stateless operators on streams).
"""

__version__ = "0.1.0"
