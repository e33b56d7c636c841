"""Per-cell interval analytics on Spark DataFrames.

``operators`` holds DataFrame-to-DataFrame building blocks, ``functions`` column and
numeric functions, ``sources`` readers and writers, ``plans`` whole analyses composed of
them, ``streaming`` their incremental form.
"""
