"""A Spark-native engine for lexical data: dictionaries, texts, search, linkage and corpus studies."""
