import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with a column of a clashing name, from (doc_id, text) or longer rows."""

    def make(rows, extra=True):
        full = [(*r, *("en", "src0")[len(r) - 2 :], len(r[1] or "")) if len(r) < 5 else r for r in rows]
        df = spark.createDataFrame(full, DOC)
        if extra:
            from pyspark.sql import functions as F

            for c in ("component", "digest", "n", "score", "slot", "position", "sub", "rank", "host"):
                df = df.withColumn(c, F.lit("clash"))
        return df

    return make
