"""newsloom: a Spark-native engine for multilingual news and text analytics."""
