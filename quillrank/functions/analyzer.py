"""Text analysis: tokens of a text, and boolean lexical queries as syntax trees."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_TERMS = 64


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, in order and with repeats; NULL for NULL."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Group:
    """``kind``: and, or, phrase."""

    kind: str
    parts: tuple


_TOKEN = re.compile(r"\s*(<->|<\d+>|[&|!()]|'(?:[^']|'')*'|[^\s&|!()<>']+)")


def parse(text: str):
    """The tree of a query in ``& | ! <-> ( )`` form; None for an empty one. Binding from tightest: ``!``, ``<->``, ``&``, ``|``. Prefix terms (``foo:*``) are refused."""
    found, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected input at {at}: {text!r}")
        found.append(m[1])
        at = m.end()
    if not found:
        return None
    place = 0

    def peek():
        return found[place] if place < len(found) else None

    def take():
        nonlocal place
        place += 1
        return found[place - 1]

    def level(kind, signs, below):
        parts = [below()]
        while peek() is not None and signs(peek()):
            take()
            parts.append(below())
        return parts[0] if len(parts) == 1 else Group(kind, tuple(parts))

    def either():
        return level("or", lambda t: t == "|", both)

    def both():
        return level("and", lambda t: t == "&", phrase)

    def phrase():
        return level("phrase", lambda t: t.startswith("<"), negated)

    def negated():
        if peek() == "!":
            take()
            return Not(negated())
        if peek() == "(":
            take()
            inner = either()
            if peek() != ")":
                raise ValueError("missing )")
            take()
            return inner
        if peek() is None or peek() in "&|)" or peek().startswith("<"):
            raise ValueError("a term is missing")
        word = take().strip("'").replace("''", "'")
        if word.endswith(":*"):
            raise ValueError("prefix terms are not supported")
        return Term(word.split(":")[0].lower())

    tree = either()
    if peek() is not None:
        raise ValueError(f"unexpected {peek()!r}")
    return tree


def web(text: str):
    """The tree of a search-box query: words are and-ed, ``or`` between two words, ``-word`` negates, quotes make phrases."""
    alternatives, now = [], []
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if word.lower() == "or" and not minus and not quoted and now:
            alternatives.append(now)
            now = []
            continue
        words = [Term(w) for w in re.findall(r"[^\W_]+", (quoted or word).lower())]
        if words:
            part = words[0] if len(words) == 1 else Group("phrase", tuple(words))
            now.append(Not(part) if minus else part)
    alternatives.append(now)
    built = [a[0] if len(a) == 1 else Group("and", tuple(a)) for a in alternatives if a]
    return None if not built else built[0] if len(built) == 1 else Group("or", tuple(built))


def positive_terms(tree) -> list[str]:
    """The terms under an even number of negations, each once, in order. More than ``MOST_TERMS`` are refused."""
    out: dict[str, None] = {}

    def walk(node, even):
        if isinstance(node, Term):
            if even:
                out[node.text] = None
        elif isinstance(node, Not):
            walk(node.part, not even)
        elif node is not None:
            for p in node.parts:
                walk(p, even)

    walk(tree, True)
    if len(out) > MOST_TERMS:
        raise ValueError(f"a query has at most {MOST_TERMS} terms")
    return list(out)


def shape(tree) -> str:
    """How a query matches: ``none``, ``one``, ``any``, ``all`` or ``tree``, by its terms and the kinds of operators in it."""
    kinds = set()

    def walk(node):
        if isinstance(node, Not):
            walk(node.part)
        elif isinstance(node, Group):
            kinds.add(node.kind)
            for p in node.parts:
                walk(p)

    walk(tree)
    terms = positive_terms(tree)
    if not terms:
        return "none"
    if len(terms) == 1 and not kinds & {"and", "or"}:
        return "one"
    if "or" in kinds and "and" not in kinds:
        return "any"
    if "and" in kinds and "or" not in kinds:
        return "all"
    return "tree"


def condition(tree, has, *, strict_not: bool = False) -> Column:
    """The match as a Column; ``has(term)`` says whether the record has a term. A phrase is an AND, a NOT is true whatever is in it, unless ``strict_not``."""
    terms = positive_terms(tree)
    kind = "tree" if strict_not and terms else shape(tree)
    if kind == "none":
        return F.lit(False)
    if kind in ("one", "any", "all"):
        parts = [has(t) for t in terms]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if kind == "all" else out | p
        return out

    def build(node):
        if isinstance(node, Term):
            return has(node.text)
        if isinstance(node, Not):
            return ~build(node.part) if strict_not else F.lit(True)
        out = build(node.parts[0])
        for p in node.parts[1:]:
            out = out | build(p) if node.kind == "or" else out & build(p)
        return out

    return build(tree)


def is_identifier(term: str) -> bool:
    """Whether a term looks like an identifier: 16 characters or more, ``_`` or ``-`` in it, or 6 or more with a letter and a digit."""
    return len(term) >= 16 or "_" in term or "-" in term or (len(term) >= 6 and any(c.isalpha() for c in term) and any(c.isdigit() for c in term))
