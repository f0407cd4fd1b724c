"""The join of embeddings where nothing can be left out."""

import numpy as np
import pytest

from sliceloom.llm import embeddings


@pytest.mark.parametrize("short", [True, False])
def test_every_pair_against_all(spark, monkeypatch, short):
    for name, value in (("FINE", 8), ("COARSE", 16), ("CHUNK", 48)):
        monkeypatch.setattr(embeddings, name, value)
    met, whole = [], embeddings._every_pair
    monkeypatch.setattr(embeddings, "_every_pair", lambda *a: met.append(1) or whole(*a))
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 32))
    for i in range(40):
        x[260 + i] = x[int(rng.integers(260 + i))] + rng.normal(0, 0.08, 32)
    x[7] = x[9]
    x = x.astype(np.float32).astype(float) if short else x
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
    assert met
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.arange(len(x))
    while True:
        fresh = np.minimum(label, np.where(linked, label[None], len(x)).min(axis=1))
        if (fresh == label).all():
            break
        label = fresh
    assert got == {i: (int(linked[i].sum()), int(label[i])) for i in range(len(x))}
    assert linked.sum() > 60
