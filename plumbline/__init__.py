"""A PySpark-native engine that counts conventions: sites, slots, gates, baselines and findings."""
