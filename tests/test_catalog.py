"""Every query with SQL gives the same rows as that SQL."""

import math

import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return v.isoformat()[:26] if hasattr(v, "isoformat") else repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want


#: What queries without SQL must hold on any tables: a test of their rows.
def _mixture(rows):
    assert rows and all(r["copies"] >= 1 and r["n_tokens"] >= 0 for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)


def _shares(rows):
    assert abs(sum(r["actual_share"] for r in rows) - 1) < 1e-9 and abs(sum(r["target_share"] for r in rows) - 1) < 1e-9
    assert all(r["used_tokens"] <= r["max_repeats"] * r["available_tokens"] and abs(r["used_tokens"] - r["planned_tokens"]) <= 400 for r in rows)


def _cut(rows):
    assert 0 < len(rows) < 30 and len({r["doc_id"] for r in rows}) == len(rows)


def _cut_shares(rows):
    assert rows and all(0 <= r["n_cut"] <= r["n_docs"] and abs(r["cut_share"] - r["n_cut"] / r["n_docs"]) < 1e-12 for r in rows)


def _changes(rows):
    assert rows and {r["drift_kind"] for r in rows} <= {"renamed", "removed", "added", "retyped"} and all((r["drift_kind"] == "renamed") == (r["new_path"] != "") for r in rows)


def _spans(rows):
    assert rows and all(1 <= r["first_no"] <= r["last_no"] for r in rows)
    seen = {}
    for r in rows:
        for n in range(r["first_no"], r["last_no"] + 1):
            assert seen.setdefault((r["producer"], r["path"], n), r["type"]) == r["type"]


def _table(rows):
    assert rows and len({r["raw_id"] for r in rows}) == len(rows) and any(r["card_cause_id"] for r in rows)


def _grid(rows):
    counts = [r["cluster_count_internal"] for r in sorted(rows, key=lambda r: r["distance_threshold"])]
    assert len(rows) == 41 and counts == sorted(counts, reverse=True) and all(-1 <= r["silhouette"] <= 1 for r in rows)


def _choice(rows):
    assert len(rows) == 1 and 0.2 <= rows[0]["distance_threshold"] <= 1.2


def _cards(rows):
    assert rows and {r["level"] for r in rows} <= {"low", "medium", "high"} and all(r["evidence"] >= 1 for r in rows)


def _typical(rows):
    assert rows and {r["rank"] for r in rows} <= {1, 2, 3} and all(r["size"] >= r["rank"] for r in rows)


HELD = {
    "p9_mix": _mixture, "p9_shares": _shares, "p9_feasible_shares": _shares, "p10_found": _cut, "p10_sources": _cut_shares, "p6_found": _changes, "p6_lifespans": _spans, "p6_table": _table, "agglomerative_grid": _grid,
    "select_threshold": _choice, "cause_cards_v3": _cards, "p7_clusters": _typical, "p7_token_clusters": _typical,
}


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_query_without_sql_holds(spark, data, name):
    HELD[name](entry.queries()[name](spark, data).collect())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_cause_cards_take_the_most_complete_card(spark, data, tmp_path):
    from pyspark.sql import functions as F

    cards = spark.read.parquet(f"{data}/crash_cards.parquet")
    raws = spark.read.parquet(f"{data}/raw_cause_cards.parquet")
    poor = cards.withColumns({"card_id": F.lit("zzz") if dict(cards.dtypes)["card_id"] == "string" else F.lit(10**12) + F.col("card_id"), "stack_semantic": F.lit(None).cast(cards.schema["stack_semantic"].dataType)})
    poor = poor.withColumn("repro", F.lit(None).cast(cards.schema["repro"].dataType)).select(cards.columns)
    got = []
    for name, some in (("a", cards), ("b", poor.unionByName(cards)), ("c", cards.limit(0))):
        raws.write.parquet(f"{tmp_path}/{name}/raw_cause_cards.parquet")
        some.coalesce(1).write.parquet(f"{tmp_path}/{name}/crash_cards.parquet")
        got.append(sorted(map(repr, entry.queries()["cause_cards_v3"](spark, f"{tmp_path}/{name}").collect())))
    assert got[0] == got[1]
    assert len(got[2]) == len(got[0]) > 0
