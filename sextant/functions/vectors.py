"""Dense vectors in array columns: dot product, norms, cosine, and the grade of a similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Similarities above which a text is relevant (1) and highly relevant (2).
GRADES = ((0.65, 2), (0.35, 1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either has length 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def grade(similarity: Column) -> Column:
    """2, 1 or 0; null stays null."""
    out = F.when(similarity.isNull(), F.lit(None).cast("int"))
    for least, value in GRADES:
        out = out.when(similarity > least, value)
    return out.otherwise(0)


def grade_of(title_similarity: Column, text_similarity: Column) -> Column:
    """The grade of a document: of the mean of its title's and its text's similarity to the query."""
    return grade((title_similarity + text_similarity) / 2)


def grade_of_reply(reply: Column) -> Column:
    """The grade in a model's JSON reply, null unless it is 0, 1 or 2."""
    found = F.from_json(reply, "grade int")["grade"]
    return F.when(found.isin(0, 1, 2), found)
