"""Operators that a training-data pipeline needs beside the analytics library. Nothing else imports this package."""
