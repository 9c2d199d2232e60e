"""Operators of a training-data pipeline: formatting, packing, tokenising, extraction, filtering and deduplication.

Nothing outside this folder imports it. Each operator module works on any DataFrame that has the
named key and text columns and returns a DataFrame with a fixed schema, so further input columns
never clash with what it adds.
"""
