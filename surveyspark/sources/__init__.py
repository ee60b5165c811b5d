"""Readers: microdata files, dictionaries, star tables, report files."""
