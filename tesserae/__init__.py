"""tesserae: a Spark-native analytics engine for document catalogues and their usage data."""
