"""Boolean full-text search as column predicates over token arrays.

A document's tokens are an array, so a term is ``array_contains`` and a query one boolean expression: a
search is a filter of the scan and shuffles nothing, however many terms it has.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The stemmer's suffixes and what takes their place, tried in this order.
SUFFIXES = """
ational ate
tional tion
enci ence
anci ance
izer ize
ation ate
alism al
iveness ive
fulness ful
ousness ous
aliti al
iviti ive
biliti ble
alli al
entli ent
eli e
ousli ous
ement -
ment -
ent -
ness -
ful -
less -
able -
ible -
al -
ive -
ous -
ant -
ence -
ance -
er -
ic -
ment -
ing -
ion -
ed -
es -
ly -
"""
RULES = [(s, "" if t == "-" else t) for s, t in map(str.split, SUFFIXES.strip().splitlines())]


def stem(word: Column) -> Column:
    """The first rule whose suffix fits, if enough of the word is left; words of up to 3 bytes stay."""
    size = F.octet_length(word)
    out = F.when(size <= 3, word)
    for suffix, instead in RULES:
        kept = F.substr(word, F.lit(1), F.length(word) - len(suffix))
        out = out.when((size > len(suffix) + 2) & word.endswith(suffix), F.concat(kept, F.lit(instead)))
    return out.otherwise(word)


def stem_text(word: str) -> str:
    """The same for one word of a query."""
    size = len(word.encode())
    for suffix, instead in RULES if size > 3 else ():
        if size > len(suffix) + 2 and word.endswith(suffix):
            return word[: -len(suffix)] + instead
    return word


def words_of(*texts: Column) -> Column:
    """Words as they come: split at white space, letters and digits only (so don't is dont), lower case."""
    bare = F.regexp_replace(F.lower(F.concat_ws(" ", *texts)), r"[^\p{L}\p{Nd}\p{IsWhite_Space}]", "")
    return F.split(bare, r"\p{IsWhite_Space}+")


def tokens(*texts: Column, tokenizer: str = "simple") -> Column:
    """Distinct words, stemmed if the tokenizer is porter."""
    words = F.filter(words_of(*texts), lambda w: w != "")
    return F.array_distinct(F.transform(words, stem) if tokenizer == "porter" else words)


def parse(query: str) -> list[list[tuple[bool, str]]]:
    """Groups joined by OR, of terms joined by AND (or by nothing), each wanted or, after NOT, unwanted."""
    groups: list[list[tuple[bool, str]]] = [[]]
    wanted = True
    for raw in query.replace('"', " ").replace("'", "").split():
        word = raw.upper()
        if word == "OR":
            groups.append([])
            wanted = True
        elif word == "NOT":
            wanted = not wanted
        elif word != "AND":
            term = re.sub(r"[\W_]", "", raw.lower())
            if term:
                groups[-1].append((wanted, term))
            wanted = True
    return [g for g in groups if g]


def match(words: Column, query: str, tokenizer: str = "simple") -> Column:
    """Whether a token array fits a query; an empty query fits nothing."""
    return _fits(query, lambda term: F.array_contains(words, stem_text(term) if tokenizer == "porter" else term))


def _fits(query: str, has: Callable[[str], Column]) -> Column:
    found = F.lit(False)
    for group in parse(query):
        every = F.lit(True)
        for wanted, term in group:
            every = every & (has(term) if wanted else ~has(term))
        found = found | every
    return found


def unstemmed(term: str) -> list[str]:
    """All words whose stem is this one: itself, or with a rule turned back, if the rules then lead here."""
    back = {term} | {term[: len(term) - len(i)] + s for s, i in RULES if term.endswith(i)}
    return sorted(w for w in back if stem_text(w) == term)


def search(docs: DataFrame, columns: list[str], query: str, tokenizer: str = "simple") -> DataFrame:
    """The rows of which any of the columns, taken together, fit the query.

    The words are made once a row, however many terms there are: they are bound to a lambda's variable. With
    the porter tokenizer it is the term that is turned into the words of its stem; no word is stemmed.
    """

    def test(words: Column) -> Column:
        return _fits(query, lambda t: F.arrays_overlap(words, F.array(*map(F.lit, unstemmed(stem_text(t))))) if tokenizer == "porter" else F.array_contains(words, t))

    return docs.where(F.element_at(F.transform(F.array(words_of(*[F.col(c) for c in columns])), test), 1))


def index(docs: DataFrame, key: str, columns: list[str], tokenizer: str = "simple") -> DataFrame:
    """(key, tokens): to be stored once where many searches follow."""
    return docs.select(key, tokens(*[F.col(c) for c in columns], tokenizer=tokenizer).alias("tokens"))


def add_documents(stored: DataFrame, docs: DataFrame, key: str, columns: list[str], tokenizer: str = "simple") -> DataFrame:
    """The index with these documents new or anew."""
    new = index(docs, key, columns, tokenizer)
    return remove_documents(stored, docs.select(key), key).unionByName(new)


def remove_documents(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys.select(key), key, "left_anti")


def search_index(stored: DataFrame, key: str, query: str, tokenizer: str = "simple") -> DataFrame:
    return stored.where(match(F.col("tokens"), query, tokenizer)).select(key)


def postings(stored: DataFrame, key: str) -> DataFrame:
    """(token, documents): how many documents have each token."""
    return stored.select(key, F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("documents"))
