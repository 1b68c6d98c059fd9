"""Table functions for SQL: SELECT * FROM t, LATERAL text_tokens(t.text)."""

from __future__ import annotations

from pyspark.sql import SparkSession


class TextTokens:
    """position and token of a text, by runs of letters and digits in lower case."""

    def eval(self, text: str):
        at, word = 0, ""
        for c in f"{text or ''} ":
            if c.isalnum():
                word += c.lower()
            elif word:
                yield at, word
                at, word = at + 1, ""


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register("text_tokens", udtf(TextTokens, returnType="position int, token string"))
