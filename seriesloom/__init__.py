"""seriesloom: analytics for families of related time series, expressed as Spark DataFrame plans.

Layers
------
``functions``  column expressions (no data movement)
``operators``  DataFrame -> DataFrame building blocks
``sources``    readers, page tables, sinks and the keyed store
``plans``      compositions (masters, tuning, back-test, serving) and the query catalog
"""

__version__ = "0.1.0"
