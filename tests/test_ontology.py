"""Label validation, axes, scoped closures, sweeps and ranks of large groups against plain Python."""

import itertools
import json
import random
import re

import numpy as np
import pytest

from verdure.operators import distance, models, ontology, ranks

NAMES = {"tissue": ["root", "whole plant", "Leaf"], "treatment": ["Heat", "Salt", "Control"], "medium": ["MS"]}
SUBS = {"treatment": {"intensity": [0, 1, 2, 3], "phase": ["day", "night"]}}


def by_hand(text):
    """{axis: [(val, {sub: value})]}"""
    bare = re.sub(r"```(?:json)?\s*|\s*```", "", text or "").strip()
    said = {}
    for cand in (bare, (re.search(r"\{.*?\}", bare, re.DOTALL) or [""])[0]):
        try:
            said = json.loads(cand)
            break
        except json.JSONDecodeError:
            pass
    out = {}
    for axis, names in NAMES.items():
        raw = said.get(axis) if isinstance(said, dict) else None
        raw = [] if raw is None or raw == "unspecified" else raw if isinstance(raw, list) else [raw]
        items = []
        for x in raw:
            d = x if isinstance(x, dict) else {"val": x}
            low = re.sub(r"""^["'\s]+|["'\s]+$""", "", str(d.get("val", "unspecified"))).lower()
            subs = {}
            for sub, allowed in SUBS.get(axis, {}).items():
                v = d.get(sub) if isinstance(x, dict) else None
                try:
                    v = type(allowed[0])(v) if v is not None else None
                except (TypeError, ValueError):
                    v = None
                subs[sub] = str(v if v in allowed else allowed[0])
            items.append(({n.lower(): n for n in names}.get(low, "unspecified"), subs))
        items = items or [("unspecified", {s: str(a[0]) for s, a in SUBS.get(axis, {}).items()})]
        if axis == "treatment":
            items = [(v, {**s, "intensity": "0"} if v == "Control" else s) for v, s in items]
            best = {}
            for v, s in items:
                if v not in best or int(s["intensity"]) > int(best[v]["intensity"]):
                    best[v] = s
            items = [(v, best[v]) for v in dict.fromkeys(v for v, _ in items)]
        out[axis] = items
    return out


def test_labels_of_every_shape(spark):
    rng = random.Random(2)
    vals = ["heat", " 'Salt' ", "CONTROL", "leaf", "WHOLE plant", "nothing", "unspecified", 7, None, "", "Root"]
    item = lambda: rng.choice([lambda: rng.choice(vals), lambda: {"val": rng.choice(vals[:7]), "intensity": rng.choice([0, 1, 3, "2", " 1 ", 2.9, "2.5", "x", None, 9, -1]), "phase": rng.choice(["night", "Night", None])}, lambda: {"intensity": 2}])()
    label = lambda: rng.choice([item, lambda: [item() for _ in range(rng.randrange(5))], lambda: []])()
    texts = [json.dumps({a: label() for a in NAMES if rng.random() < 0.8}) for _ in range(300)]
    texts = [rng.choice([t, t, f"```json\n{t}\n```", f"``` {t} ```"]) for t in texts]
    texts += [None, "", "no json", "{bad", "[1]", "so: {\"tissue\": \"leaf\"} I think", "7", '{"tissue": "leaf"} {"tissue": "root"}', '{"treatment": {"val": "Heat", "intensity": true}}']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, answer string")
    names = spark.createDataFrame([(a, n) for a, v in NAMES.items() for n in v], "axis string, name string")
    labels = ontology.validated(df, "answer", names, SUBS, strongest={"treatment": ("intensity", "Control")})
    got = {(r.id, r.axis): [(x.val, dict(x.subs)) for x in r["items"]] for r in labels.collect()}
    want = {(k, a): v for k, t in enumerate(texts) for a, v in by_hand(t).items()}
    for k in want:
        assert got[k] == want[k], (texts[k[0]], k)
    assert got.keys() == want.keys()
    flat = {(r.id, r.axis): r.value for r in ontology.flattened(labels).collect()}
    assert all(flat[k, f"{a}{s}"] == " + ".join(x[1][s[1:]] if s else x[0] for x in v) for (k, a), v in want.items() for s in (["", "_intensity", "_phase"] if a == "treatment" else [""]))


def test_labels_are_worked_on_where_they_stand(spark):
    """Nothing is shuffled and answers are read once; among many names each is found; names of the same letters are the least of them."""
    names = spark.createDataFrame([("tissue", f"Name {k}") for k in range(300)] + [("tissue", "NAME 7"), ("tissue", None)], "axis string, name string")
    df = spark.createDataFrame([(k, json.dumps({"tissue": [f" name {k}'", "other"]})) for k in range(300)], "id long, answer string")
    flat = ontology.flattened(ontology.validated(df, "answer", names))
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Union" not in plan
    assert {r.id: r.value for r in flat.collect()} == {k: f"{'NAME' if k == 7 else 'Name'} {k} + unspecified" for k in range(300)}


def brute_closure(edges):
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
        up.setdefault(p, set())
    out = set()
    for n in up:
        todo, seen = [n], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up[x]
        out |= {(n, a) for a in seen}
    return out


@pytest.mark.parametrize("name", ["diamonds", "deep", "tangle"])
def test_scoped_closure(spark, name):
    if name == "diamonds":  # 2^9 ways from the bottom to the top
        edges = [(f"{k}{s}", f"{k + 1}{u}") for k in range(9) for s in "ab" for u in "ab"]
        roots = ["4a"]
    elif name == "deep":
        edges, roots = [(str(k), str(k + 1)) for k in range(20)], ["15", "missing"]
    else:
        rng = random.Random(1)
        edges = [(str(a), str(b)) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(70)) if a < b]
        roots = ["35", "20", "39"]
    nodes = sorted({x for e in edges for x in e} | {"lone"})
    space = {n: "xyz"[len(n + "!") % 2 + (n[-1] in "02468b")] for n in nodes}
    e = spark.createDataFrame(edges, "child string, parent string")
    terms = spark.createDataFrame(list(space.items()), "go_id string, namespace string")
    full = brute_closure(edges) | {(n, n) for n in nodes}
    below = {n for n, a in full if a in roots}
    keep = ("x", "y")
    for r, ns in ((None, ()), (roots, ()), (roots, keep), (None, keep)):
        got = {tuple(x) for x in ontology.scoped_closure(e, terms, spark.createDataFrame([(x,) for x in r], "k string") if r else None, ns).collect()}
        assert got == {(n, a) for n, a in full if (r is None or a in below) and (not ns or space[a] in ns) and (r is None or n in below)}
    ann = spark.createDataFrame([("g", edges[0][0]), ("h", "unknown")], "gene_id string, go_id string")
    up = ontology.scoped_closure(e, terms)
    assert {tuple(x) for x in ontology.propagated(ann, up).collect()} == {("g", a) for n, a in full if n == edges[0][0]}


def plain_ranks(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_rank_sweep(spark):
    rng = np.random.default_rng(3)
    d, x, y, z = rng.integers(0, 40, 300) / 7, rng.integers(0, 2, 300) * 1.0, rng.integers(0, 3, 300) / 2, np.ones(300)
    rows = [tuple(map(float, r)) for r in zip(d, x, y, z, strict=True)] + [(None, 1.0, 1.0, 1.0), (1.0, None, 1.0, 1.0)]
    grid = distance.weight_grid({"x": None, "y": None, "z": None})
    assert len(grid) == 7 and distance.weight_grid({"x": 1, "y": 0}) == [(1, 0)] and distance.weight_grid({"x": 0}) == []
    got = [tuple(r) for r in distance.rank_sweep(spark.createDataFrame(rows, "distance double, x double, y double, z double"), grid, ["x", "y", "z"]).collect()]
    want = {}
    for w in grid:
        s = np.round((w[0] * x + w[1] * y + w[2] * z) / sum(w), 12)
        want[w] = None if len(set(s)) == 1 else np.corrcoef(plain_ranks(d), plain_ranks(s))[0, 1]
    assert {g[:3] for g in got} == set(want) and all((g[3] is None) == (want[g[:3]] is None) and (g[3] is None or abs(g[3] - want[g[:3]]) < 1e-9) for g in got)
    order = [g[3] for g in got if g[3] is not None]
    assert order == sorted(order) and got[-1][3] is None


@pytest.mark.parametrize("rows", [10, 1 << 17])
def test_large_groups_by_ranges(spark, rows):
    rng = random.Random(4)
    data = [(g, k, rng.choice([round(rng.random(), 2), 0.5, None if k % 13 == 0 else 0.25])) for g, n in (("a", 400), ("b", 5), ("c", 60), (None, 30)) for k in range(n)]
    df = spark.createDataFrame(data, "g string, k int, p double").repartition(5)
    got = {(r.g, r.k): r for r in models.adjust_bh(df, "p", ("g",), rows=rows).collect()}
    assert len(got) == len(data)
    for g in ("a", "b", "c", None):
        ps = sorted(p for h, _, p in data if h == g and p is not None)
        for h, k, p in data:
            if h == g:
                adj = got[g, k].adj_p
                assert adj is None if p is None else abs(adj - min(1, min(q * len(ps) / (i + 1) for i, q in itertools.islice(enumerate(ps), ps.index(p), None)))) < 1e-9
    data += [("a", 900, float("nan"))]
    out = ranks.rank_percentile(spark.createDataFrame(data, "g string, k int, p double"), ("g",), "p", "k", rows=rows).collect()
    for g in ("a", "b", "c", None):
        mine = sorted((r for r in out if r.g == g), key=lambda r: (r.p is not None, r.p is not None and r.p != r.p, r.p if r.p == r.p else None, r.k) if r.p is None or r.p == r.p else (True, True, 0, r.k))
        assert [r.term_rank for r in mine] == list(range(1, len(mine) + 1)) and all(r.n_terms == len(mine) and abs(r.percentile - (r.term_rank - 1) / (len(mine) - 1) * 100) < 1e-9 for r in mine)


def test_closure_of_cycles_and_long_chains(spark):
    from verdure.operators.enrich import closure

    for edges in ([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "a")], [(f"{k:03d}", f"{k + 1:03d}") for k in range(70)]):
        got = [tuple(r) for r in closure(spark.createDataFrame(edges, "child string, parent string")).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_closure([e for e in edges if e[0]])


def test_lists_with_kept_ancestors_read_edges_once(spark):
    from verdure.operators.enrich import ancestor_lists

    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "d"), ("x", "b"), ("e", "e")]
    got = {r.node: sorted(r.ancestors) for r in ancestor_lists(spark.createDataFrame(edges, "child string, parent string"), spark.createDataFrame([("d",), ("a",)], "ancestor string")).collect()}
    want = brute_closure(edges)
    assert got == {n: sorted(a for m, a in want if m == n and a in "ad") for n in "abcdex"}
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    chain = spark.createDataFrame([(f"{k:02d}", f"{k + 1:02d}") for k in range(6)], "child string, parent string").mapInPandas(counted, "child string, parent string")
    terms = spark.createDataFrame([(f"{k:02d}", "x") for k in range(7)], "go_id string, namespace string")
    assert ontology.scoped_closure(chain, terms, spark.createDataFrame([("06",)], "k string"), ("x",)).count() == 28 and read.value == 6
