"""tessera: Spark-native evaluation of text embeddings over large corpora.

Every operator is a DataFrame -> DataFrame function built from Spark SQL
expressions, joins, windows and aggregates.  See README.md for the layout.
"""

__version__ = "0.1.0"
