"""Labels whose documents the input does not have change no fit."""

import numpy as np

from tidemark.llm import mixing, toxicity


def test_mixing_takes_labels_of_the_input(spark):
    docs = spark.createDataFrame([(k, ("alpha beta " if k % 3 == 0 else "delta zeta ") * (k % 4 + 1)) for k in range(60)], "doc_id bigint, text string")
    own = [(k, "x" if k % 3 == 0 else "y") for k in range(60)]
    absent = [(k, "x") for k in range(1000, 3000)]
    want = mixing.learn(docs, spark.createDataFrame(own, "doc_id bigint, domain string"), sample=60)
    got = mixing.learn(docs, spark.createDataFrame(own + absent, "doc_id bigint, domain string"), sample=60)
    assert got == want and np.allclose(np.exp(got.prior), [1 / 3, 2 / 3])


def test_toxicity_takes_labels_of_the_input(spark):
    docs = spark.createDataFrame([(k, "a fine day here. you foul wretch." if k % 3 == 0 else "a fine day here. we walk on.") for k in range(60)], "doc_id bigint, text string")
    own = [(k, int(k % 3 == 0)) for k in range(60)]
    absent = [(k, 0) for k in range(1000, 3000)]
    want = toxicity.learn(docs, spark.createDataFrame(own, "doc_id bigint, toxic int"), max_rows=60)
    got = toxicity.learn(docs, spark.createDataFrame(own + absent, "doc_id bigint, toxic int"), max_rows=60)
    assert want.weights.any() and np.array_equal(got.weights, want.weights) and got.bias == want.bias
