"""Operators for preparing training corpora, one module each; nothing else imports them."""
