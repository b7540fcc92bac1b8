"""Joins and counts that stay linear and spread out when one key is huge."""
