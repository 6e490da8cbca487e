"""The registered queries and their SQL twins."""

from evidentia.plans import base, data_queries, eval_queries, text_queries


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)


__all__ = ["base", "data_queries", "eval_queries", "oracle_sql", "queries", "text_queries"]
