"""A Spark-native lexical search and scoring engine over positional postings."""
