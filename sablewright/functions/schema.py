"""The closed vocabularies of the evidence graph, and expressions that map raw values into them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal those of existing data.
ENTITY_TYPES = ("method", "model", "algorithm", "dataset", "problem", "task", "equation", "software", "metric", "domain")
#: Spellings and the types that they mean.
ENTITY_TYPE_OF = {
    "method": "method", "methods": "method", "physics method": "method", "technique": "method", "approach": "method",
    "model": "model", "models": "model", "architecture": "model",
    "algorithm": "algorithm", "algorithms": "algorithm",
    "dataset": "dataset", "datasets": "dataset", "data set": "dataset", "corpus": "dataset", "benchmark": "dataset",
    "problem": "problem", "problems": "problem",
    "task": "task", "tasks": "task",
    "equation": "equation", "equations": "equation", "pde": "equation",
    "software": "software", "tool": "software", "framework": "software", "library": "software",
    "metric": "metric", "metrics": "metric", "measure": "metric",
    "domain": "domain", "field": "domain",
}
PREDICATES = ("USES_METHOD", "USES_MODEL", "USES_DATASET", "USES_SOFTWARE", "SOLVES", "EVALUATED_BY", "IMPROVES", "OUTPERFORMS", "COMPARES_WITH", "EXTENDS", "BASED_ON", "UNKNOWN")
#: Spellings and the predicates that they mean.
PREDICATE_OF = {
    "uses method": "USES_METHOD", "use method": "USES_METHOD",
    "uses model": "USES_MODEL", "use model": "USES_MODEL",
    "uses dataset": "USES_DATASET", "use dataset": "USES_DATASET", "evaluates on": "USES_DATASET", "evaluated on": "USES_DATASET",
    "uses software": "USES_SOFTWARE", "use software": "USES_SOFTWARE",
    "solves": "SOLVES", "solve": "SOLVES", "addresses": "SOLVES", "was employed to address": "SOLVES", "employed to solve": "SOLVES",
    "evaluated by": "EVALUATED_BY", "measured by": "EVALUATED_BY",
    "improves": "IMPROVES", "improve": "IMPROVES",
    "outperforms": "OUTPERFORMS", "outperform": "OUTPERFORMS",
    "compares with": "COMPARES_WITH", "compared with": "COMPARES_WITH",
    "extends": "EXTENDS", "extend": "EXTENDS", "proposes": "EXTENDS",
    "based on": "BASED_ON", "is based on": "BASED_ON",
}
#: Relation of the older graph to predicate, and back.
RELATION_PREDICATE = {"proposes": "EXTENDS", "uses": "USES_METHOD", "improves": "IMPROVES", "compares_with": "COMPARES_WITH", "evaluates_on": "USES_DATASET", "measures_with": "EVALUATED_BY", "studies": "SOLVES"}
PREDICATE_RELATION = {"USES_METHOD": "uses", "USES_MODEL": "uses", "USES_DATASET": "uses", "USES_SOFTWARE": "uses", "SOLVES": "studies", "EVALUATED_BY": "measures_with", "IMPROVES": "improves", "OUTPERFORMS": "compares_with", "COMPARES_WITH": "compares_with", "EXTENDS": "proposes", "BASED_ON": "uses", "UNKNOWN": "studies"}
STANCES = ("support", "contradict")
REVIEW_STATUSES = ("auto_verified", "needs_review", "confirmed", "rejected")
USABLE = ("auto_verified", "confirmed")
# End of the fixed values.


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(pairs.items())))


def _words(c: Column) -> Column:
    """Lower case, with runs of white space, underscores and hyphens as one space."""
    return F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[_\s-]+", " "))


def entity_type(c: Column) -> Column:
    """A type of the vocabulary, or null."""
    return F.try_element_at(_lookup(ENTITY_TYPE_OF), _words(c))


def predicate(c: Column) -> Column:
    """A predicate of the vocabulary; UNKNOWN for what is in none of its spellings."""
    upper = F.translate(F.upper(F.trim(F.coalesce(c, F.lit("")))), "- ", "__")
    names = _lookup(PREDICATE_OF)
    older = F.try_element_at(_lookup(RELATION_PREDICATE), F.replace(_words(c), F.lit(" "), F.lit("_")))
    return F.when(upper.isin(*PREDICATES), upper).otherwise(F.coalesce(F.try_element_at(names, _words(c)), older, F.lit("UNKNOWN")))


def predicate_of_relation(relation: Column, object_type: Column) -> Column:
    """The predicate of an older relation; ``uses`` depends on what is used."""
    name = F.lower(F.trim(F.coalesce(relation, F.lit(""))))
    kind = F.lower(F.coalesce(object_type, F.lit("")))
    used = F.when(kind == "model", "USES_MODEL").when(kind == "dataset", "USES_DATASET").when(kind == "software", "USES_SOFTWARE").otherwise("USES_METHOD")
    return F.when(name == "uses", used).otherwise(F.coalesce(F.try_element_at(_lookup(RELATION_PREDICATE), name), predicate(relation)))


def relation_of_predicate(c: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(PREDICATE_RELATION), predicate(c)), F.lit("studies"))


def fact_signature(subject: Column, pred: Column, obj: Column) -> Column:
    return F.concat_ws("|", F.coalesce(subject, F.lit("")), pred, F.coalesce(obj, F.lit("")))


def hashed_id(prefix: str, *parts: Column, size: int = 24) -> Column:
    """``prefix`` and the beginning of the SHA-256 of the parts joined by bars."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"), 256), 1, size))
