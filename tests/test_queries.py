"""Every registered query of the analyses against its SQL twin, on the small test tables."""

import collections
import glob
import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__
from cadenza.operators import graph, subset
from cadenza.plans.queries import ORACLES, QUERIES
from cadenza.sources import tables as T

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LARGER = os.environ.get("TEST_LARGER_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}")
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(cols).collect()), key=repr)
    want = sorted((tuple(map(plain, r)) for r in duck.sql(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()), key=repr)
    assert got == want


# queries that SQL cannot express: their rows against brute force or what must hold of them


def rows(spark, name, folder=SF):
    return [r.asDict() for r in QUERIES[name](spark, folder).collect()]


def by_graph(rs):
    out = {}
    for r in rs:
        out.setdefault(r["graph"], []).append(r)
    return out


def test_communities(spark):
    edges, parts = by_graph(rows(spark, "induced_topn_edges")), by_graph(rows(spark, "communities"))
    sizes, cells = by_graph(rows(spark, "community_sizes")), by_graph(rows(spark, "adjacency_cells"))
    assert edges and edges.keys() == parts.keys() == sizes.keys() == cells.keys()
    for g, es in edges.items():
        weight = {(e["a"], e["b"]): e["weight"] for e in es}
        part = {r["node"]: r["community"] for r in parts[g]}
        assert set(part) == {x for e in weight for x in e} and len(parts[g]) == len(part)
        nodes = sorted(part)
        a = np.array([[weight.get((min(x, y), max(x, y)), 0) if x != y else 0 for y in nodes] for x in nodes], float)
        own = np.array([part[x] for x in nodes])
        best = graph.modularity(a, own)
        assert best > graph.modularity(a, np.arange(len(nodes)))
        for c in set(own.tolist()):  # joining two communities gains nothing
            for k in set(own.tolist()):
                assert graph.modularity(a, np.where(own == k, c, own)) <= best + 1e-9
        n = collections.Counter(part.values())
        assert {r["community"]: (r["n"], r["place"]) for r in sizes[g]} == {c: (m, k + 1) for k, (c, m) in enumerate(sorted(n.items(), key=lambda x: (-x[1], x[0])))}
        place = {c: k for k, c in enumerate(sorted(n, key=lambda c: (-n[c], c)))}
        order = sorted(nodes, key=lambda x: (place[part[x]], -a[nodes.index(x)].sum(), x))
        at = {x: i for i, x in enumerate(order)}
        want = {(at[x], at[y]): w for (x, y), w in weight.items()} | {(at[y], at[x]): w for (x, y), w in weight.items()}
        assert {(r["i"], r["j"]): r["weight"] for r in cells[g]} == want


def test_layout(spark):
    one, two = rows(spark, "graph_layout"), rows(spark, "graph_layout")
    key = lambda r: (r["graph"], r["node"])
    assert sorted(one, key=key) == sorted(two, key=key) and all(math.isfinite(r["x"] + r["y"]) for r in one)
    assert {key(r) for r in one} == {key(r) for r in rows(spark, "communities")}


def test_projection(spark, duck):
    data = duck.sql("select vec_id, embedding from embeddings order by vec_id").fetchall()
    x = np.array([e for _, e in data], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:2]
    got = {r["item_id"]: (r["x"], r["y"]) for r in rows(spark, "embedding_projection")}
    want, own = x @ axes.T, np.array([got[i] for i, _ in data])
    for k in range(2):  # up to the sign
        assert min(abs(own[:, k] - s * want[:, k]).max() for s in (1, -1)) < 1e-5


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="the smallest tables have too few points")
def test_embedding_figures(spark):
    points, parts = by_graph(rows(spark, "embedding_points", LARGER)), by_graph(rows(spark, "communities", LARGER))
    ratio = {r["graph"]: r for r in rows(spark, "embedding_separation", LARGER)}
    centre, sides = by_graph(rows(spark, "community_centroids", LARGER)), by_graph(rows(spark, "community_contrast", LARGER))
    assert points
    for g, ps in points.items():
        assert {p["node"]: p["community"] for p in ps}.items() <= {p["node"]: p["community"] for p in parts[g]}.items() and len(ps) >= 5
        assert sorted(p["place"] for p in ps) == list(range(1, len(ps) + 1))
        x, c = np.array([(p["x"], p["y"]) for p in ps]), np.array([p["community"] for p in ps])
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        other, same = c[:, None] != c[None], (c[:, None] == c[None]) & ~np.eye(len(c), dtype=bool)
        far, near = [d[i][m].mean() for i, m in enumerate(other) if m.any()], [d[i][m].mean() for i, m in enumerate(same) if m.any()]
        want = np.mean(far) / np.mean(near) if far and near else 0.0
        assert ratio[g]["n"] == len(ps) and ratio[g]["ratio"] == pytest.approx(want, abs=2e-3)
        n = collections.Counter(c.tolist())
        assert {r["community"]: r["n"] for r in centre[g]} == dict(n)
        for r in centre[g]:
            assert (r["x"], r["y"]) == pytest.approx(tuple(x[c == r["community"]].mean(axis=0)), abs=1e-5)
        large = sorted(n, key=lambda k: (-n[k], k))[:2]
        want = {"smallest": x[c == min(n, key=lambda k: (n[k], k))], "largest": x[np.isin(c, large)]}
        for r in sides[g]:
            assert r["n"] == len(want[r["side"]]) and (r["x"], r["y"]) == pytest.approx(tuple(want[r["side"]].mean(axis=0)), abs=1e-5)


def test_user_sample(spark, duck):
    got = [r["uid"] for r in rows(spark, "hash_user_sample")]
    users = {r[0] for r in duck.sql("select distinct user_id from events").fetchall()}
    assert len(got) == len(set(got)) == min(50, len(users)) and set(got) <= users
    ev = T.listens_ev(spark, SF)
    assert sorted(r.uid for r in subset.hash_sample(ev.repartition(7), "uid", 50).select("uid").distinct().collect()) == sorted(got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """Events of 5,100 users, more than a sample of users held."""
    folder = str(tmp_path_factory.mktemp("crowd"))
    ks = "(1), (11), (21), (32)"
    c = duckdb.connect()
    c.execute(f"""copy (select row_number() over () as event_id, timestamp '2024-01-01 00:00:00' + to_seconds(u * 7 + k * 60) as ts, u as user_id, if(k % 2 = 0, 'click', 'view') as event_type,
        (u % 90)::double as value, '{{"k": ' || k || '}}' as props from range(5100) r(u), (values {ks}) v(k) where (u + k) % 4 > 0) to '{folder}/events.parquet'""")
    c.execute(f"create view events as from '{folder}/events.parquet'")
    return folder, c


COLISTENED = ["colisten_edges_artist", "colisten_popular", "colisten_warnings", "induced_topn_edges", "subgraph_degree", "colisten_edges_item", "colisten_user_filter", "graph_labels", "matrix_totals"]


@pytest.mark.parametrize("name", COLISTENED)
def test_all_users_count(spark, crowd, name):
    folder, c = crowd
    df = QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(cols).collect()), key=repr)
    assert got and got == sorted((tuple(map(plain, r)) for r in c.sql(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()), key=repr)


def odd_events(folder, rows):
    """Events of (ts, user_id, props) as a table, and a connection to it."""
    c = duckdb.connect()
    c.execute("create table e (ts timestamp, user_id bigint, props varchar)")
    c.executemany("insert into e values (?, ?, ?)", rows)
    c.execute(f"copy (select row_number() over () as event_id, ts, user_id, 'click' as event_type, 50.0::double as value, props from e) to '{folder}/events.parquet'")
    c.execute(f"create view events as from '{folder}/events.parquet'")
    return c


def same_as_sql(spark, folder, c, name):
    df = QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(cols).collect()), key=repr)
    return got and got == sorted((tuple(map(plain, r)) for r in c.sql(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()), key=repr)


@pytest.mark.parametrize("name", ["colisten_popular", "colisten_warnings", "colisten_user_filter"])
def test_events_without_user(spark, tmp_path, name):
    heard = [(u, k) for u in range(40) for k in (1, 11, 21)] + [(u, 55) for u in [*range(9), None]]  # 55 has nine listeners, ten would be popular
    c = odd_events(tmp_path, [(f"2024-01-02 10:00:{k}", u, f'{{"k": {k}}}') for u, k in heard])
    assert same_as_sql(spark, str(tmp_path), c, name)


@pytest.mark.parametrize("name", ["colisten_warnings", "induced_topn_edges", "subgraph_degree", "colisten_edges_item", "graph_labels"])
def test_events_before_the_first_tick(spark, tmp_path, name):
    """1 is heard three seconds before noon and 11 three seconds after it, on other days as days go from noon to noon."""
    heard = [("2023-12-11 11:59:57", 1), ("2023-12-11 12:00:03", 11), ("2024-01-02 10:00:00", 21), ("2024-01-02 11:00:00", 32)]
    c = odd_events(tmp_path, [(ts, u, f'{{"k": {k}}}') for u in range(40) for ts, k in heard])
    assert same_as_sql(spark, str(tmp_path), c, name)


@pytest.mark.parametrize("name", ["colisten_popular", "colisten_user_filter", "colisten_edges_item"])
def test_items_of_odd_props(spark, tmp_path, name):
    props = ['{"k": 1}', '{"a": {"k": 11}}', '{"k": 21, "k": 7}', '{"k": 32.5}', '{"k": 0043', '{"k":54}']
    c = odd_events(tmp_path, [(f"2024-01-02 10:{i}:00", u, p) for u in range(40) for i, p in enumerate([*props, None])])
    assert same_as_sql(spark, str(tmp_path), c, name)
