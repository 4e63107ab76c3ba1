"""The session fixture is the one of tests/conftest.py."""
