"""PySpark-native analytics for one-way paging signals and the short texts they carry."""
