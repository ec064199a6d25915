"""recordloom: DataFrame operators over verifiable record logs and their text."""

__version__ = "0.1.0"
