"""pagewright: a PySpark-native page-audit and corpus-preparation engine."""
