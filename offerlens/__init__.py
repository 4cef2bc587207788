"""PySpark-native analytics over collected shop pages, offers and registries."""
