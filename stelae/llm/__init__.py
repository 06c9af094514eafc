"""Operators for preparing training text; nothing else imports them."""
