"""Spark-native feature jobs over a social-post firehose."""
