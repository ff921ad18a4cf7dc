"""Boolean retrieval: a query becomes a tree on the driver and one predicate over each document's terms."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORDS, tokenize


class QuerySyntaxError(ValueError):
    """A query that has no tree."""


@dataclass(frozen=True)
class Term:
    word: str

    def column(self, terms: Column) -> Column:
        return F.array_contains(terms, self.word)


@dataclass(frozen=True)
class Not:
    of: Term | Not | And | Or

    def column(self, terms: Column) -> Column:
        return ~self.of.column(terms)


@dataclass(frozen=True)
class And:
    left: Term | Not | And | Or
    right: Term | Not | And | Or

    def column(self, terms: Column) -> Column:
        return self.left.column(terms) & self.right.column(terms)


@dataclass(frozen=True)
class Or:
    left: Term | Not | And | Or
    right: Term | Not | And | Or

    def column(self, terms: Column) -> Column:
        return self.left.column(terms) | self.right.column(terms)


def parse_boolean(query: str) -> Term | Not | And | Or:
    """The tree of words, &, |, ! and brackets; ! binds most, | least. Raises QuerySyntaxError."""
    tokens = re.findall(r"\w+|[()&|!]", query.lower())
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def unary():
        nonlocal at
        token = peek()
        if token is None or token in "&|)":
            raise QuerySyntaxError(f"an operand is missing in {query!r}")
        at += 1
        if token == "!":
            if peek() == "!":
                raise QuerySyntaxError("! twice")
            return Not(unary())
        if token == "(":
            inner = binary(0)
            if peek() != ")":
                raise QuerySyntaxError("a bracket is not closed")
            at += 1
            return inner
        return Term(token)

    def binary(level: int):
        nonlocal at
        if level == 2:
            return unary()
        left = binary(level + 1)
        sign, make = ("|", Or) if level == 0 else ("&", And)
        while peek() == sign:
            at += 1
            left = make(left, binary(level + 1))
        return left

    tree = binary(0)
    if at < len(tokens):
        raise QuerySyntaxError(f"no operator before {tokens[at]!r}")
    return tree


def boolean_search(docs: DataFrame, query: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ids of the documents that fit: one scan, no join."""
    terms = docs.select(F.col(doc_id).alias("doc_id"), F.array_distinct(tokenize(text, WORDS)).alias("_t"))
    return terms.where(parse_boolean(query).column(F.col("_t"))).select("doc_id")


def search_postings(postings: DataFrame, words: list[str], every: bool = True) -> DataFrame:
    """doc_id of documents with all (or any) of the words, from build_postings()."""
    rows = postings.where(F.col("term").isin(words)).select("term", F.explode("docs").alias("doc_id"))
    hits = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    return hits.where(F.col("n") >= (len(set(words)) if every else 1)).select("doc_id")
