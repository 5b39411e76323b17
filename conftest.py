"""Puts the repository on the path of the tests."""
