"""streetflow: trip and street-network analytics as Spark DataFrame jobs.

Sub-packages
    functions   Column -> Column helpers (geometry, projection, text)
    operators   DataFrame -> DataFrame building blocks (grid join, overlap, clip, quantiles, graph)
    sources     readers, writers and the synthetic tables used by tests and bench
    plans       finished analyses composed from the above
    streaming   empty on purpose: the workload is batch only
"""
