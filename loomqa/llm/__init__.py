"""Operators that prepare training data; optional, nothing else imports this package."""
