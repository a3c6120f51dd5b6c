"""Spark-native operators for instruction variants and rollout analytics."""
