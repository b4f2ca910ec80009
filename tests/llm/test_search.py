"""Neighbours, clusters, leaks and cut texts against brute force, with their edge cases."""

import re

import numpy as np
import pyarrow as pa
import pytest

from faultloom.llm import clusters, leaks, neighbours, truncation
from faultloom.llm import vectors as V

KIND = "vec_id long, vector array<float>, rep int"


def grouped_vectors(seed=0, groups=14, dim=32):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dim)
        for _ in range([3, 8, 40][g % 3]):
            rows.append(centre / np.linalg.norm(centre) + rng.normal(scale=0.06, size=dim))
    rows += list(rng.normal(size=(15, dim)))
    rows += [rows[5] * 7.0] + [rows[6]] * 30
    x = np.array(rows)[rng.permutation(len(rows))].astype(np.float32)
    table = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    n = len(x)
    return x, [*table, (n, None, 0), (n + 1, [0.0] * dim, 0), (n + 2, [float("nan")] * dim, 0), (n + 3, [1.0], 0), (n + 4, [], 0)]


def cosines(x):
    x = x.astype(np.float64)
    return x @ x.T / np.outer(*[np.linalg.norm(x, axis=1)] * 2)


def found_clusters(df, label="t"):
    cells = clusters.kmeans_cells(df, "vec_id", "vector", label=label)
    return set() if cells is None else {(r["cluster"], r["vec_id"]) for r in clusters.tight_clusters(cells, label=label).collect()}


def exact_clusters(x, least=0.7):
    near, want = cosines(x) >= least, set()
    for i in range(len(x)):
        m = np.flatnonzero(near[i])
        if len(m) >= 3 and m[0] == i and (near[m].sum(1) == len(m)).all() and near[np.ix_(m, m)].all():
            want |= {(int(i), int(j)) for j in m}
    return want


def test_neighbours_recall(spark):
    x, rows = grouped_vectors()
    got = {}
    for r in neighbours.most_similar(spark.createDataFrame(rows, KIND), "vec_id", "vector", 5).collect():
        got.setdefault(r["vec_id"], {})[r["rank"]] = (r["other_id"], r["similarity"])
    s = np.round(cosines(x), 6)
    hits = total = 0
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], j))[:5]
        assert sorted(got[i]) == [1, 2, 3, 4, 5] and all(a[1] >= b[1] for a, b in zip(list(dict(sorted(got[i].items())).values()), list(dict(sorted(got[i].items())).values())[1:], strict=False))
        hits += len({v[0] for v in got[i].values()} & set(order))
        total += 5
    assert set(got) == set(range(len(x))) and hits / total >= 0.9


def test_equal_vectors_take_the_smallest_ids(spark):
    rows = [(i, [1.0, 2.0], 0) for i in range(9)] + [(20, [2.0, -1.0], 0)]
    got = {(r["vec_id"], r["rank"]): r["other_id"] for r in neighbours.most_similar(spark.createDataFrame(rows, KIND), "vec_id", "vector", 2, least=0.5).collect()}
    assert got == {(i, k): [j for j in range(9) if j != i][k - 1] for i in range(9) for k in (1, 2)}


def test_no_vectors(spark):
    empty = spark.createDataFrame([], KIND)
    assert neighbours.most_similar(empty, "vec_id", "vector").count() == 0
    assert clusters.kmeans_cells(empty, "vec_id", "vector") is None
    useless = spark.createDataFrame([(1, None, 0), (2, [0.0, 0.0], 0)], KIND)
    assert neighbours.most_similar(useless, "vec_id", "vector").count() == 0
    assert found_clusters(useless) == set()


def test_codes_weigh_parallel_errors_more():
    rng = np.random.default_rng(2)
    unit = V.unit_rows(rng.normal(size=(2000, 16)))
    zero = np.zeros(16, np.float32)
    plain, aware = neighbours.AnisotropicCodes.fit(unit, unit, steps=3), neighbours.AnisotropicCodes.fit(unit, unit, steps=8)

    def along(c):
        return float(np.abs(np.einsum("ij,ij->i", unit, unit) - np.diag(c.scores(unit[:300], c.encode(unit - zero, unit)[:300])).mean()).mean())

    assert along(aware) < along(plain) + 1e-6
    approx, exact = aware.scores(unit[:50], aware.encode(unit, unit)), unit[:50] @ unit.T
    assert np.corrcoef(approx.ravel(), exact.ravel())[0, 1] > 0.9


def test_clusters_equal_brute_force(spark):
    x, rows = grouped_vectors(4)
    cells = clusters.kmeans_cells(spark.createDataFrame(rows, KIND), "vec_id", "vector")
    got = {(r["cluster"], r["vec_id"]) for r in clusters.tight_clusters(cells).collect()}
    want = exact_clusters(x)
    assert got == want and want
    weights = spark.createDataFrame([(i, 2.0) for i in range(len(x))], "vec_id long, weight double")
    d = {r["cluster"]: r for r in clusters.described(clusters.clusters_of(cells), weights).filter("rank = 1").collect()}
    sizes = {}
    for c, _ in want:
        sizes[c] = sizes.get(c, 0) + 1
    assert all(d[c]["size"] == n and d[c]["weight"] == 2 * n for c, n in sizes.items())


def test_members_are_those_nearest_to_a_centroid(spark):
    x, rows = grouped_vectors(11)
    cells = clusters.kmeans_cells(spark.createDataFrame(rows, KIND), "vec_id", "vector")
    centres = {r["label"]: np.frombuffer(r["vec"], np.float32) for r in cells.centres.collect()}
    names = sorted(centres)
    cos = V.unit_rows(x) @ np.stack([centres[n] for n in names]).T
    for r in cells.assigned.collect():
        i = r["rep"]
        assert r["label"] == names[cos[i].argmax()] and abs(r["near"] - cos[i].max()) < 1e-5
    sums = {}
    for r in cells.assigned.collect():
        sums[r["label"]] = sums.get(r["label"], 0) + V.unit_rows(x[[r["rep"]]])[0].astype(float)
    agree = [float(centres[n] @ (s / np.linalg.norm(s))) for n, s in sums.items()]
    assert min(agree) > 0.99


def test_large_cells_and_clusters_are_handled_in_blocks(spark, monkeypatch):
    x, rows = grouped_vectors(6, 5)
    df = spark.createDataFrame(rows, KIND)
    whole = found_clusters(df)
    near = {tuple(r) for r in neighbours.most_similar(df, "vec_id", "vector", 3).collect()}
    monkeypatch.setattr(clusters, "BLOCK", 8)
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    assert found_clusters(df) == whole == exact_clusters(x)
    assert {tuple(r) for r in neighbours.most_similar(df, "vec_id", "vector", 3).collect()} == near
    monkeypatch.setattr(V, "SPLIT", 10)
    monkeypatch.setattr(neighbours, "GATHERED", 20)
    assert found_clusters(df) == whole
    got = {tuple(r) for r in neighbours.most_similar(df, "vec_id", "vector", 3).collect()}
    assert len(got & near) / len(near) > 0.9


def test_chains_are_no_clusters(spark):
    angle = lambda a: [float(np.cos(a)), float(np.sin(a))]
    assert found_clusters(spark.createDataFrame([(i, angle(0.6 * i), 0) for i in range(4)], KIND)) == set()


def test_a_neighbour_outside_spoils_a_cluster(spark):
    rng = np.random.default_rng(3)
    centre = np.eye(1, 24)[0]
    group = [centre + rng.normal(scale=0.08, size=24) for _ in range(30)]
    far = [np.eye(24)[5] + rng.normal(scale=0.03, size=24) for _ in range(12)]
    between = V.unit_rows(group[4][None])[0] * 0.75 + np.eye(24)[9] * 0.66  # near one member only
    x = np.array([*group, *far, between]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    want = exact_clusters(x)
    assert {c for c, _ in want} == {30}
    assert found_clusters(spark.createDataFrame(rows, KIND)) == want


def test_connected_sets(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    got = {r["node"]: r["root"] for r in clusters.connected(spark.createDataFrame(chain, "a long, b long"), "t").collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), 101: 100, 102: 100}
    assert clusters.connected(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_near_rows_join_through_steps():
    angle = np.array([0.0, 0.5, 1.0, 1.5, 4.0])
    x = np.stack([np.cos(angle), np.sin(angle)], 1).astype(np.float32)
    assert clusters.join_near(np.array([9, 3, 8, 5, 1]), x, 0.8).tolist() == [3, 3, 3, 3, 1]


def test_vectors_as_bytes():
    x = np.arange(12, dtype=np.float32).reshape(3, 4)
    packed = V.to_bytes(x)
    assert (V.to_matrix(packed) == x).all() and (V.to_matrix(packed.slice(1, 2)) == x[1:]).all() and V.to_matrix(packed.slice(0, 0)).size == 0


def test_oversampled_seeds_find_every_group(spark):
    x, rows = grouped_vectors(2)
    reps = V.vector_table(spark.createDataFrame(rows, KIND), "vec_id", "vector", "t").withColumnRenamed("vec_id", "rep")
    seeds = V.oversampled_seeds(reps, 29)
    assert (V.unit_rows(x) @ seeds.T).max(1).mean() > 0.8 and len(seeds) == 29
    assert (V.oversampled_seeds(reps.repartition(5), 29) == seeds).all()


def test_hashed_features(spark):
    df = spark.createDataFrame([(["a", "b", "a", None], [1.0, 2.0, None, 3.0]), (None, None), ([], [])], "t array<string>, w array<double>")
    got = [r[0] for r in df.select(clusters.hashed_features(df["t"], 16, df["w"])).collect()]
    assert sum(abs(v) for v in got[0]) in (4.0, 0.0) and got[1] == got[2] == [0.0] * 16


def words(t):
    return [w for w in ("".join(c for c in p if c.isalnum()) for p in (t or "").lower().split()) if w]


def brute_leaks(docs, items, n=16):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs for k in range(len(words(t)) - n + 1) for i in grams.get(tuple(words(t)[k : k + n]), ())}


@pytest.mark.parametrize("shard", [40, 1_000_000])
def test_leaks_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(leaks, "SHARD_WORDS", shard)
    rng = np.random.default_rng(1)
    item = lambda n: " ".join(f"w{v}" for v in rng.integers(0, 9, n))
    items = [(1, item(30)), (2, item(16)), (3, item(15)), (4, None), (5, "")]
    a, b = items[0][1], items[1][1]
    docs = [(10, a), (11, "x " + a.upper().replace(" ", " -- ") + " y"), (12, " ".join(a.split()[5:21])), (13, " ".join(a.split()[5:20])), (14, b + " " + a), (15, None), (16, ""),
            (17, "  ".join([*a.split()[:9], ";;", *a.split()[9:]])), (18, a + " " + a), (19, " ".join(a.split()[:10] + ["stop"] + a.split()[10:]))] + [(30 + i, item(60)) for i in range(20)]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, item_id int").coalesce(2)
    found = leaks.leaked_spans(df, spark.createDataFrame(items, "item_id long, text string"))
    rows = found.collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == brute_leaks(docs, items)
    spans = {(r["doc_id"], r["item_id"]): (r["first_word"], r["end_word"]) for r in rows}
    assert spans[11, 1] == (1, 31) and spans[14, 1] == (16, 46) and spans[12, 1] == (0, 16)
    assert leaks.leaked_spans(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert leaks.leaked_spans(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_index_counts_and_locates():
    rng = np.random.default_rng(0)
    runs = [rng.integers(1, 4, n) for n in (30, 1, 50)]
    text = np.concatenate([np.append(r, 0) for r in runs])
    index = leaks.FMIndex(text, 4)
    for phrase in ([1], [1, 2], [3, 3, 1], [2, 1, 2, 3]):
        want = [i for i in range(len(text) - len(phrase) + 1) if text[i : i + len(phrase)].tolist() == phrase]
        low, high = index.search(np.array([phrase]))
        assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def test_words():
    parent, found = leaks.words_of(pa.array(["A-b  c D　e ;; É1", None, ""]))
    assert found.to_pylist() == ["ab", "c", "d", "e", "é1"] and parent.tolist() == [0] * 5


def test_cut_texts(spark):
    whole = [(i, "s", f"The thing number {i} fell over. It took {i} ms.") for i in range(60)]
    logs = [(100 + i, "l", "\n".join(f"[ {k}.{i}] task {k} took {i + k} us" for k in range(6))) for i in range(40)]
    mail = [(200 + i, "m", f"Hello {i}, it broke.\n\nbest,\nthe crew") for i in range(20)]
    cut = [(300, "s", "The thing number 7 fell ov"), (301, "s", "It ended. Then the …"), (302, "l", "[ 1.0] task 1 took 3 us\n[ 2.0] task 2 to"), (303, "s", "See ```\ncode. Text."), (304, "m", "It was &am"), (305, "s", "a [truncated]")]
    fine = [(400, "s", "They said it was cut off (truncated)."), (401, "s", "She said “stop.”"), (402, None, None), (403, "s", ""), (404, "s", "  \n "), (405, "s", "```\ncode\n```\nDone!"), (406, "z", "这是完整的。")]
    df = spark.createDataFrame([(*r, 0) for r in whole + logs + mail + cut + fine], "doc_id long, source string, text string, kind int")
    got = {r["doc_id"] for r in truncation.truncation_scores(df).filter("cut").collect()}
    assert got == {r[0] for r in cut}
    assert truncation.truncation_scores(df.limit(0)).count() == 0


def test_limit_decides_between_equal_endings(spark):
    rng = np.random.default_rng(5)
    line = lambda i: f"[ {i % 90}.{rng.integers(100, 999)}] task {'x' * rng.integers(1, 40)} freed object {rng.integers(10**9, 10**10)}"
    texts = ["\n".join(line(i + k) for k in range(max(1, int(rng.lognormal(1.8, 0.6))))) for i in range(800)]
    stored = {i: t[:500] for i, t in enumerate(texts)}
    in_number = {i for i, t in enumerate(texts) if len(t) > 500 and re.search(r"object \d{7,9}$", t[:500])}
    whole = {i for i, t in enumerate(texts) if len(t) < 500}
    assert len(in_number) > 5 and len(whole) > 400
    df = spark.createDataFrame([(i, "l", t) for i, t in stored.items()], "doc_id long, source string, text string")
    scores = {r["doc_id"]: r for r in truncation.truncation_scores(df).collect()}
    assert {scores[i]["ending"] for i in in_number} == {"usual"} == {scores[i]["ending"] for i in whole}
    assert all(scores[i]["cut"] for i in in_number) and not any(scores[i]["cut"] for i in whole)


def _prose(rng, n):
    word = lambda: "".join("abcdefghijklmnopqrst"[i] for i in rng.integers(0, 20, rng.integers(3, 10)))
    return " ".join(f"{word().title()} {' '.join(word() for _ in range(int(rng.integers(2, 12))))}." for _ in range(n))


def test_length_outweighs_the_ending_both_ways(spark):
    rng = np.random.default_rng(8)
    clean = [_prose(rng, int(rng.integers(1, 14))) for _ in range(3000)]
    texts = [_prose(rng, int(rng.integers(1, 14))) for _ in range(1500)]
    at = 300
    cut = [t[:at] for t in texts]
    finished = _prose(rng, 30)
    while not finished[:at].endswith("."):
        finished = finished[int(rng.integers(1, 5)) :]
    odd = finished[:90].rstrip(".") + "x"
    rows = [(i, "clean", t) for i, t in enumerate(clean)] + [(5000 + i, "cuts", t) for i, t in enumerate(cut)]
    rows += [(9000, "clean", odd), (9001, "cuts", finished[:at]), (9002, "clean", finished[:at]), (9003, "cuts", (odd + " y" * 300)[: at - 1] + "z")]
    got = {r["doc_id"]: r for r in truncation.truncation_scores(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got[9001]["ending"] == got[9002]["ending"] == "complete" and got[9001]["cut"] and not got[9002]["cut"]
    assert got[9000]["ending"] == got[9003]["ending"] == "unknown" and got[9003]["cut"] and not got[9000]["cut"]
    assert got[9001]["evidence"] == got[9002]["evidence"] < 0 < got[9000]["evidence"] == got[9003]["evidence"]


def test_limits_of_long_texts(spark):
    rng = np.random.default_rng(4)
    texts = ["\n".join(_prose(rng, 20) for _ in range(int(n))) for n in rng.lognormal(3.2, 0.6, 120)]
    stored = [t[:70_000] for t in texts for _ in (0,)]
    rows = [(i, "long", t) for i, t in enumerate(stored)]
    whole_at = [i for i, t in enumerate(texts) if len(t) > 70_000]
    assert len(whole_at) > 5
    got = {r["doc_id"]: r for r in truncation.truncation_scores(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert {(got[i]["posterior"] > 0.5, got[i]["cut"], got[i]["ending"] == "complete") for i in whole_at} <= {(True, True, False), (True, True, True), (True, False, True)}, [(i, got[i]) for i in whole_at]


def test_length_fits():
    rng = np.random.default_rng(3)
    sizes = np.minimum(np.exp(rng.normal(5, 0.7, 4000)).astype(int), 280)
    values, counts = np.unique(sizes, return_counts=True)
    found = truncation.fit_censored(values, counts)
    assert set(found) == {280} and found[280] > 0.9
    values, counts = np.unique(np.exp(rng.normal(5, 0.7, 4000)).astype(int), return_counts=True)
    assert truncation.fit_censored(values, counts) == {} and truncation.fit_censored(values[:2], counts[:2]) == {}


def test_one_dense_group_holding_most_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SCANNED", 4000)
    rng = np.random.default_rng(9)
    x = (np.eye(1, 24)[0] + rng.normal(scale=0.03, size=(300, 24))).astype(np.float32)
    got = {}
    for r in neighbours.most_similar(spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], KIND), "vec_id", "vector", 5).collect():
        got.setdefault(r["vec_id"], set()).add(r["other_id"])
    s = np.round(cosines(x), 6)
    want = {i: set(sorted((j for j in range(300) if j != i), key=lambda j: (-s[i, j], j))[:5]) for i in range(300)}
    assert sum(len(got[i] & want[i]) for i in want) / 1500 >= 0.98
