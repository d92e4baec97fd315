"""Formulas as SQL functions, inlined by the optimizer."""

from __future__ import annotations

from pyspark.sql import SparkSession

from evidentia.functions.text import ACCENTED, FOLDED

FUNCTIONS = {
    "fold_text": ("x string", "string", f"translate(lower(x), '{ACCENTED}', '{FOLDED}')"),
    "fold_tokens": ("x string", "array<string>", f"array_distinct(transform(regexp_extract_all(lower(coalesce(x, '')), '(\\\\p{{L}}{{3,}})', 1), w -> substring(regexp_replace(translate(w, '{ACCENTED}', '{FOLDED}'), '^(.{{4,}})s$', '$1'), 1, 6)))"),
    "coverage": ("q array<string>, t array<string>", "double", "round(coalesce(try_divide(size(array_intersect(q, t)), size(q)), 0.0), 6)"),
    "rrf": ("r array<int>, k int", "double", "aggregate(r, 0.0D, (a, x) -> a + coalesce(1.0D / (k + x), 0.0D))"),
    "cosine": ("a array<double>, b array<double>", "double", "try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0.0D, (s, v) -> s + v), sqrt(aggregate(a, 0.0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0.0D, (s, v) -> s + v * v)))"),
}


def register(spark: SparkSession) -> None:
    """Makes :data:`FUNCTIONS` known to the session."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
