"""newsloom: a PySpark-native analytics engine for news and article text."""
