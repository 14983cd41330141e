"""Named SQL functions, so that plain SQL users have the scalar operators.  They are SQL text that Catalyst inlines, no Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from posegrain.functions.mixtures import unary_score

_FUNCTIONS = {
    "pg_oks": ("d2 double, area double, kappa double", "double", "if(area > 0, exp(-d2 / (2D * area * kappa * kappa)), null)"),
    "pg_u_gmm": ("det double, beta double", "double", "1D - exp(-beta * det)"),
    "pg_fuse_softmax": ("base double, gmm double", "double", "(exp(base) * base + exp(gmm) * gmm) / (exp(base) + exp(gmm))"),
    "pg_fuse_gate": ("base double, gmm double, k int", "double", "if(k = 2, gmm, base)"),
    "pg_unary_score": ("weight double, cxx double, cxy double, cyy double", "double", unary_score()),
    "pg_slug": ("s string", "string", "regexp_replace(regexp_replace(s, '[^a-zA-Z0-9]+', '_'), '^_+|_+$', '')"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions as temporary SQL functions; returns their names."""
    for name, (args, kind, body) in _FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({args}) returns {kind} return {body}")
    return list(_FUNCTIONS)
