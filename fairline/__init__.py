"""Prematch odds analytics as Spark jobs: feeds, identity, history, read models."""

RULE_VERSION = "prematch-v1"
