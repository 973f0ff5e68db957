"""Shares the fixtures of the folder above."""
