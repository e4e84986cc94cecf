"""PySpark-native operational and document analytics."""
