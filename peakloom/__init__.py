"""PySpark-native analytics for chromatography mass spectrometry."""
