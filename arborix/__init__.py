"""A PySpark-native engine for tree-, graph-, mesh- and point-shaped data."""
