"""A PySpark-native engine for episodic, multi-part time-series tables."""
