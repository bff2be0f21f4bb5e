"""Spark-native audit analytics: detectors, post-processing, gates, inventory and streams as DataFrame plans."""
