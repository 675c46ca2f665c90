"""The path tree against a plain fold over the documents."""

import json
import random
from collections import Counter

import pytest

from millrace.operators.nested import path_tree


def kind(v):
    if v is None:
        return "null"
    if isinstance(v, dict):
        return "object"
    if isinstance(v, list):
        return "array"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int" if -(2**31) <= v < 2**31 else "long"
    return "double" if isinstance(v, float) else "string"


def folded(docs):
    kinds, above, wide = {}, {"": None}, {}

    def walk(v, path):
        k = kind(v)
        kinds.setdefault(path, Counter())[k] += 1  # keeps the order of first sight
        if k == "string":
            wide[path] = max(len(v), wide.get(path, 0))
        for key, x in v.items() if k == "object" else ():
            inner = f"{path}.{key}" if path else key
            above[inner] = path
            walk(x, inner)
        for x in v if k == "array" else ():
            above[f"{path}[]"] = path
            walk(x, f"{path}[]")

    for d in docs:
        walk(d, "")
    out = {}
    for path, c in kinds.items():
        shapes, types = Counter(), Counter()
        for k, n in c.items():
            if k != "null":
                shapes[k if k in ("object", "array") else "scalar"] += n
                if k not in ("object", "array"):
                    types[k] += n
        present = sum(c.values())
        absent = 0 if path.endswith("[]") or above[path] is None else sum(kinds[above[path]].values()) - present
        top = lambda x: x.most_common(1)[0][0] if x else None
        if path or top(shapes) != "object" or len(shapes) > 1:
            out[path] = (top(shapes), len(shapes), top(types), len(types), present, c["null"], absent, c["null"] > 0 or absent > 0, wide.get(path))
    return out


def value(rng, depth):
    r = rng.random()
    if depth and r < 0.25:
        return {k: value(rng, depth - 1) for k in rng.sample(["a", "b", "c d", "é"], rng.randrange(4))}
    if depth and r < 0.45:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, 3, -(2**31), 2**31, 1.5, 2e300, "", "x", "ünïcode", "true"])


@pytest.mark.parametrize("docs", ["random", "odd"])
def test_tree_against_a_fold(spark, docs):
    rng = random.Random(7)
    docs = [{k: value(rng, 3) for k in rng.sample("pqr", rng.randrange(4))} for _ in range(120)] if docs == "random" else [1, "s", [1, {"a": None}], {"a": {"b": []}}, None, {"a": "t"}, {"a": 5}]
    rows = [(i, json.dumps(d), "x") for i, d in enumerate(docs)] + [(1000, "no json", "x"), (1001, None, "x")]
    rng.shuffle(rows)
    got = path_tree(spark.createDataFrame(rows, "n int, j string, path string"), "j", ["n"]).collect()
    assert {r["path"]: tuple(r)[1:] for r in got} == folded(docs)
    assert len(got) == len(folded(docs))


def test_no_documents(spark):
    assert path_tree(spark.createDataFrame([(None,), ("{",)], "j string"), "j").count() == 0
    assert path_tree(spark.createDataFrame([("{}",)], "j string"), "j").count() == 0
