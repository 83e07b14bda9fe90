"""Spark-first engine for turning positioned text into tables and reconciling them."""
