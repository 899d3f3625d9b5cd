import random

import pytest
from pyspark.sql import types as T

from tests_llm_helpers import sentence

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) pairs or (id, text, lang, source)."""
    def make(rows, partitions=3):
        full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "s0")), len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(partitions)
    return make


@pytest.fixture(scope="session")
def awkward():
    """Rows with NULL ids, NULL and empty texts, repeats, one very long text, ties and words across lines."""
    rng = random.Random(5)
    passage = " ".join(sentence(rng, 12) for _ in range(9))
    rows = [(i, " ".join(sentence(rng, rng.randint(6, 14)) for _ in range(rng.randint(1, 12)))) for i in range(30)]
    rows += [(30, None), (31, ""), (32, "   \n\t "), (33, "ein"), (34, "ein zwei drei vier"), (None, "ohne Nummer " + passage), (35, passage)]
    rows += [(36, "davor " + passage + " danach"), (37, passage + " " + passage), (38, rows[3][1]), (39, rows[3][1]), (39, rows[3][1])]
    rows += [(40, "é" * 30 + " " + passage.replace("w", "ü")), (41, "x" * 5000), (42, " ".join(sentence(rng, 40) for _ in range(300)))]
    return rows
