"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import learning, search, web, words
from .book import Book

BOOK = Book()
for module in (words, web, search, learning):
    module.register(BOOK)

QUERIES = BOOK.queries
ORACLE_SQL = BOOK.oracle
