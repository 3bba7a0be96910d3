"""All core queries and their SQL."""

from __future__ import annotations

from tessera.plans import catalogue, evaluation, kg, pipeline, scalars, spans

QUERIES = {**spans.QUERIES, **evaluation.QUERIES, **scalars.QUERIES, **pipeline.QUERIES, **kg.QUERIES, **catalogue.QUERIES}
SQL = {**spans.SQL, **evaluation.SQL, **scalars.SQL, **pipeline.SQL, **kg.SQL, **catalogue.SQL}
p4_found = spans.p4_found
