"""tessella: a PySpark-native engine for training-data curation and rollout analytics."""
