"""A PySpark-native engine for georeferenced point clouds and vector map overlays."""
