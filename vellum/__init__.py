"""vellum: a Spark-native engine for document rendering into other languages at corpus scale.

Books arrive as chapter rows (or as files split into pages), are validated with
ordered reject reasons, cut into chunks, translated by a pluggable function under
retry, reassembled in order, laid out as ordered element rows and published per
job, while a job-event table is reduced to the latest state in batch or as a
stream.  Everything is DataFrame / Column work; Python runs only inside the
model stage (mapInPandas) and the streaming state function.
"""

__version__ = "0.1.0"
