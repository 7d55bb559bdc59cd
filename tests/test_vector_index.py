"""The index of vectors against brute force: exact by bounds, recall of its nearest cells, odd vectors, crowded cells."""

import numpy as np

from tidewire.operators import vector_index


def brute(rows, queries, k):
    unit = lambda v: np.array(v, float) / (np.linalg.norm(v) or 1)
    out = {}
    for q, v in queries:
        scored = sorted(((-float(unit(v) @ unit(x)), i) for i, x in rows))
        out[q] = [(i, round(-s, 9)) for s, i in scored[:k]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.id, round(r.cosine, 9)))
    return out


def test_index_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * 0.3).tolist()) for i in range(900)] + [(1000 + i, centres[0].tolist()) for i in range(300)] + [(2000, [0.0] * 8), (2001, [0.0] * 8)]
    odd = [(3000, None), (3001, [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>").repartition(3)
    queries = [(q, (centres[q % 12] + rng.normal(size=8)).tolist()) for q in range(40)] + [(90, centres[0].tolist()), (91, (-centres[3]).tolist()), (92, [0.0] * 8)]
    asked = spark.createDataFrame([*queries, (95, None), (96, [1.0])], "q long, qv array<double>")
    vector_index.VectorIndex.build(df, "id", "v", f"file://{tmp_path}/index", cells=20, part_rows=100)
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/index")
    assert max(index.parts.values()) > 1 and index.rows().count() == len(rows)
    want = brute(rows, queries, 7)
    for probes in (1, 3, 50):
        found = got(index.exact(asked, "q", "qv", 7, probes))
        assert {q: [s for _, s in v] for q, v in found.items()} == {q: [s for _, s in v] for q, v in want.items()}
        assert all(found[q] == want[q] for q in range(40))
    near = got(index.search(asked, "q", "qv", 7, 6))
    assert np.mean([len({i for i, _ in near[q]} & {i for i, _ in want[q]}) / 7 for q in range(40)]) >= 0.9


def test_recall_on_the_given_vectors_and_an_empty_table(spark, tmp_path):
    from tidewire.plans import vectors

    v, q = vectors.asking(spark, "/root/testdata/sf0.1")
    index = vector_index.VectorIndex.build(v, "vec_id", "embedding", f"file://{tmp_path}/index", cells=32)
    exact, near = got(index.exact(q, "qid", "qe", 10)), got(index.search(q, "qid", "qe", 10, 22))  # these vectors point almost anywhere
    assert np.mean([len({i for i, _ in exact[k]} & {i for i, _ in near[k]}) / 10 for k in exact]) >= 0.9
    empty = vector_index.VectorIndex.build(v.limit(0), "vec_id", "embedding", f"file://{tmp_path}/empty")
    assert empty.exact(q, "qid", "qe", 10).count() == 0
