"""Operators of a training-data pipeline over tables of responses and their texts."""
